"""Request rates per minute, on a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_counts(
    requests: DataFrame, by: str = "pipeline_id", ts: str = "received_at", late: str = "2 minutes"
) -> DataFrame:
    """Requests per flow and tumbling minute; rows later than `late` are left out on a stream."""
    rows = requests.withWatermark(ts, late) if requests.isStreaming else requests
    counted = rows.groupBy(F.col(by), F.window(ts, "1 minute")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(by, F.col("window.start").alias("minute"), "n")


def over_rate(counts: DataFrame, per_minute: int) -> DataFrame:
    """The minutes in which a flow went over its rate."""
    return counts.filter(F.col("n") > per_minute)
