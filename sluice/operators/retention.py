"""Retention: what may be purged, which months may go."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.dates import month_partition
from sluice.operators.delivery import OPEN, instant
from sluice.operators.tables import keys_fit

POLICY_SCHEMA = "table_name string, months_ahead int, keep_months int"
# The policy a new installation starts with.
DEFAULT_POLICY = (("pipeline_delivery", 3, 6), ("pipeline_run", 3, 2))


def policy_frame(spark: SparkSession, rows: Sequence[tuple] = DEFAULT_POLICY) -> DataFrame:
    return spark.createDataFrame(list(rows), POLICY_SCHEMA)


def purge_candidates(
    events: DataFrame, deliveries: DataFrame, now: datetime | Column, days: int, batch_size: int
) -> DataFrame:
    """The oldest `batch_size` events past their age, minus those with an open delivery.

    The limit comes before the exclusion. The candidates are at most `batch_size`
    rows, so they go to the large delivery table, and not the other way round.
    """
    bound = instant(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    victims = (
        events.filter(F.col("created_at") < bound)
        .select("id", "created_at", "pipeline_id", "dedupe_key")
        .orderBy("created_at", "id")
        .limit(batch_size)
    )
    ids = victims.select(F.col("id").alias("event_id"), F.col("created_at").alias("_born"))
    small = keys_fit(batch_size)
    open_rows = deliveries.filter(F.col("status").isin(*OPEN)).select("event_id", "created_at")
    blocked = open_rows.join(F.broadcast(ids) if small else ids, "event_id").filter(
        (F.col("created_at") >= F.col("_born"))
        & (F.col("created_at") < F.col("_born") + F.expr("INTERVAL 1 DAY"))
    )
    blocked = blocked.select(F.col("event_id").alias("id")).distinct()
    return victims.join(F.broadcast(blocked) if small else blocked, "id", "left_anti")


def months_of(rows: DataFrame, table_name: str, at: str = "created_at") -> DataFrame:
    """Months a table holds, with row counts."""
    month = month_partition(F.col(at)).alias("month")
    return (
        rows.groupBy(month)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("table_name", F.lit(table_name))
    )


def _shifted_month(now: Column, months: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(now, "month"), months), "yyyyMM")


def partitions_expired(policy: DataFrame, existing: DataFrame, now: datetime | Column) -> DataFrame:
    """(table_name, month) partitions older than the policy keeps; keep_months <= 0 keeps all."""
    bounded = policy.filter(F.col("keep_months") > 0).select(
        "table_name", _shifted_month(instant(now), -F.col("keep_months")).alias("cutoff")
    )
    joined = existing.select("table_name", "month").distinct().join(bounded, "table_name")
    return joined.filter(F.col("month") < F.col("cutoff")).select("table_name", "month")


def out_of_horizon(
    months: DataFrame, policy: DataFrame, now: datetime | Column
) -> DataFrame:
    """Months with rows before last month or beyond `months_ahead`, with their row counts."""
    at = instant(now)
    bounds = policy.select(
        "table_name",
        _shifted_month(at, F.lit(-1)).alias("low"),
        _shifted_month(at, F.col("months_ahead")).alias("high"),
    )
    joined = months.join(bounds, "table_name")
    return joined.filter((F.col("month") < F.col("low")) | (F.col("month") > F.col("high"))).select(
        "table_name", "month", "n_rows"
    )
