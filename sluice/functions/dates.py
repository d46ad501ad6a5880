"""Date templates, month partitions, HTTP dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


_PLACEHOLDER = re.compile(r"\{today(?:\s*([+-])\s*(\d+)d)?\}")


def civil_date(now: Column, tz: Column | str) -> Column:
    """Calendar date of an instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(now, tz))


def resolve_date_template(template: str, now: Column, tz: Column | str) -> Column:
    """`{today}`, `{today-2d}`, `{today+2d}` in the zone's calendar, as YYYY-MM-DD text."""
    pieces = []
    end = 0
    for found in _PLACEHOLDER.finditer(template):
        if found.start() > end:
            pieces.append(F.lit(template[end : found.start()]))
        days = int(found.group(2) or 0) * (-1 if found.group(1) == "-" else 1)
        pieces.append(F.date_format(F.date_add(civil_date(now, tz), days), "yyyy-MM-dd"))
        end = found.end()
    if end < len(template) or not pieces:
        pieces.append(F.lit(template[end:]))
    return F.concat(*pieces)


def month_partition(at: Column) -> Column:
    """Month of an instant in UTC as YYYYMM text."""
    return F.date_format(at, "yyyyMM")
