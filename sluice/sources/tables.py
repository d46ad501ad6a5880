"""Collection windows over dated tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from sluice.functions.dates import resolve_date_template


def collection_window(
    table: DataFrame,
    ts_col: str,
    from_template: str,
    to_template: str,
    now: datetime | Column,
    tz: str,
) -> DataFrame:
    """Rows dated from the first to the last day of the window, both days included.

    The bounds depend on `now` only. They fold to constants and reach the scan
    as a range filter on the bare column.
    """
    instant = now if isinstance(now, Column) else F.lit(now)
    first = F.to_timestamp_ntz(resolve_date_template(from_template, instant, tz))
    day_after = F.date_add(F.to_date(resolve_date_template(to_template, instant, tz)), 1)
    after = day_after.cast("timestamp_ntz")
    if not isinstance(table.schema[ts_col].dataType, TimestampNTZType):
        first = F.to_utc_timestamp(first.cast("timestamp"), tz)
        after = F.to_utc_timestamp(after.cast("timestamp"), tz)
    return table.filter((F.col(ts_col) >= first) & (F.col(ts_col) < after))
