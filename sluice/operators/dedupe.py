"""First occurrences, the ledger lookup, event rows.

Rows come in as entries (see `sluice.plans.intake`). A key that occurs often is
reduced on the map side, so only one row per key and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.ids import uuid7_of

KEY = ("pipeline_id", "dedupe_key")
# Runs are committed in this order; within a run the index decides.
RUN_ORDER = ("run_created_at", "ingest_id", "page", "run_id")


def _order(*last: Column) -> Column:
    return F.struct(*RUN_ORDER, *last)


def first_occurrences(keyed: DataFrame, route_on: str = "last", contents: bool = True) -> DataFrame:
    """One row per key: its first item, how many items carried it.

    The stored payload is that of the first item. Routing follows the last item
    with the key in the same run, or the first with route_on="first". Without
    `contents` the first item comes without key source and payload: an aggregate
    sorts all it holds, and outcomes do not ask for them.
    """
    shown = ("dedupe_source", "payload") if contents else ()
    by_index = F.col("idx") if route_on == "first" else -F.col("idx")
    return keyed.groupBy(*KEY).agg(
        F.min_by(
            F.struct(*RUN_ORDER, "idx", *shown), _order(F.col("idx"))
        ).alias("first"),
        F.min_by("routes", _order(by_index)).alias("routes"),
        F.count(F.lit(1)).alias("n_items"),
    )


def dedupe_batch(keyed: DataFrame) -> DataFrame:
    """Keep the first item of every key; `surplus` counts the repeats dropped."""
    others = [c for c in keyed.columns if c not in KEY]
    first = F.min_by(F.struct(*others), _order(F.col("idx")))
    grouped = keyed.groupBy(*KEY).agg(first.alias("_f"), F.count(F.lit(1)).alias("_n"))
    return grouped.select(
        *KEY, *[F.col("_f")[c].alias(c) for c in others], (F.col("_n") - 1).alias("surplus")
    )


def event_id(created_at: Column) -> Column:
    return uuid7_of(created_at, F.col("pipeline_id"), F.col("dedupe_key"))


def resolve(firsts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Look every key up in the ledger, once.

    Adds `event_id` (of the stored original, or of the event to be made) and
    `is_new`. Only key, id and instant are read from the ledger; written as the
    bucketed table of `sluice.sinks.ledger` it is not shuffled either.
    """
    seen = ledger.select(*KEY, F.col("id").alias("_id"), F.col("created_at").alias("_at"))
    joined = firsts.join(seen, list(KEY), "left")
    created = F.col("first.run_created_at")
    return joined.select(
        *firsts.columns,
        F.col("_id").isNull().alias("is_new"),
        F.coalesce("_id", event_id(created)).alias("event_id"),
        F.coalesce("_at", created).alias("created_at"),
    )


def new_events(resolved: DataFrame) -> DataFrame:
    """Event rows of the keys not seen before, with the destinations they go to."""
    first = F.col("first")
    return resolved.filter("is_new").select(
        F.col("event_id").alias("id"),
        "created_at",
        *KEY,
        F.substring(first["dedupe_source"], 1, M.MAX_KEY_SOURCE).alias("dedupe_source"),
        first["run_id"].alias("run_id"),
        first["run_created_at"].alias("run_created_at"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        first["payload"].alias("payload"),
        F.octet_length(first["payload"]).alias("payload_bytes"),
        "routes",
    )


def resolve_duplicates(keyed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keys of the batch that the ledger holds, with the id of the original event."""
    keys = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_items"))
    seen = ledger.select(*KEY, F.col("id").alias("event_id"), "created_at")
    return keys.join(seen, list(KEY), "inner")


def find_events(ledger: DataFrame, pipeline_id: str, keys: Sequence[str] | DataFrame) -> DataFrame:
    """Events by key: a list of keys becomes a pushed filter, a frame of keys a semi join."""
    wanted = ledger.filter(F.col("pipeline_id") == pipeline_id)
    if isinstance(keys, DataFrame):
        wanted = wanted.join(keys.select("dedupe_key"), "dedupe_key", "left_semi")
    else:
        wanted = wanted.filter(F.col("dedupe_key").isin(list(keys)))
    return wanted.select("id", "created_at", *KEY)
