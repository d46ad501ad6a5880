"""Metrics kept as tables: counters that add up batch by batch, and mergeable quantile sketches of durations.

Counters: (metric, pipeline, source kind, destination, outcome, reason) -> value. Sketches: (measure, pipeline, hour).
An hour's sketches merge into days, months or flows without reading a single measurement again; `quantiles` does that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sinks.keyed import SketchTable, SummedTable
from sluice.sinks.manifest import Version

ATTRIBUTES = ("pipeline_id", "source_kind", "destination_id", "outcome", "reason")
COUNTER_SCHEMA = f"metric string, family string, {', '.join(f'{a} string' for a in ATTRIBUTES)}, value bigint"
SKETCH_SCHEMA = "measure string, month string, pipeline_id string, hour timestamp, sketch binary"
#: Sketch size; a quantile's rank is off by at most about 1.65 % (99 % confidence) for any number of merges.
KLL_K = 200
RANK_ERROR = 0.0165


def counter_table(spark: SparkSession, root: str, fan: int = 4) -> SummedTable:
    return SummedTable(spark, f"{root.rstrip('/')}/counters", COUNTER_SCHEMA, ATTRIBUTES, "metric", "family", fan, ("value",))


def sketch_table(spark: SparkSession, root: str, fan: int = 4) -> SketchTable:
    return SketchTable(spark, f"{root.rstrip('/')}/sketches", SKETCH_SCHEMA, ("pipeline_id", "hour"), "measure", "month", fan)


def add_counters(table: SummedTable, increments: DataFrame, batch: str) -> Version:
    """Add the increments of a batch (see `audit.metrics_counters`); repeating the newest batch replaces them."""
    family = F.element_at(F.split("metric", r"\."), 2)
    version = table.upsert(batch, increments.withColumn("family", family))
    return version if version.number % table.fan else table.compact()


def poll_durations(documents: DataFrame) -> DataFrame:
    """Duration of each poll cycle: from its first fetch to the end of its last, in milliseconds.

    `about.elapsed_ms` of a page says how long its fetch took, where the source measured it.
    """
    at = F.unix_millis("run_created_at")
    end = at + F.coalesce("about.elapsed_ms", F.lit(0))
    cycles = documents.groupBy("pipeline_id", "ingest_id").agg(
        F.min("run_created_at").alias("at"), (F.max(end) - F.min(at)).cast("double").alias("value")
    )
    return cycles.select("pipeline_id", "at", "value")


def hourly_sketches(rows: DataFrame, measure: str, value: str = "value", at: str = "at") -> DataFrame:
    """One sketch per flow and hour, with map-side reduction: what is shuffled is sketches."""
    hour = F.date_trunc("hour", at).alias("hour")
    kept = rows.filter(F.col(value).isNotNull() & F.col(at).isNotNull())
    grouped = kept.groupBy("pipeline_id", hour).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("sketch"))
    return grouped.select(F.lit(measure).alias("measure"), F.date_format("hour", "yyyyMM").alias("month"), "pipeline_id", "hour", "sketch")


def quantiles(sketches: DataFrame, by: Sequence[str | Column], shares: Sequence[float]) -> DataFrame:
    """Number of measurements and quantiles of merged sketches: columns n, q_<percent>."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    kept = [c for c in merged.columns if c != "sketch"]
    asked = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"q_{100 * q:g}".replace(".", "_")) for q in shares]
    return merged.select(*kept, F.kll_sketch_get_n_double("sketch").alias("n"), *asked)
