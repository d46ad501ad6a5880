"""Events to deliveries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.ids import uuid7_of
from sluice.functions.predicates import filter_paths, matches
from sluice.functions.redact import mask_url
from sluice.functions.variants import ValueOf
from sluice.spec import DestinationSpec, FlowSpec, compile_filter


def route_paths(destinations: Sequence[DestinationSpec]) -> list[str]:
    return [path for d in destinations for path in filter_paths(compile_filter(d.filter))]


def routes(destinations: Sequence[DestinationSpec], value_of: ValueOf) -> Column:
    """array<string> of the destinations whose filter accepts the item, in spec order."""
    picks = []
    for d in destinations:
        rules = compile_filter(d.filter)
        picks.append(F.when(matches(rules, value_of), F.lit(d.id)) if rules else F.lit(d.id))
    return F.array_compact(F.array(*picks))


def fan_out(
    events: DataFrame, spec: FlowSpec, now: datetime | Column, secrets: Sequence[str] = ()
) -> DataFrame:
    """One PENDING delivery per event and destination listed in its `routes`.

    Narrow: a literal array of the spec's destinations is filtered by the routes
    and exploded, so a destination that is not meant creates no row. Every
    delivery has the created_at of its event.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    declared = F.array(
        *[
            F.struct(
                F.lit(d.id).alias("id"),
                F.lit(d.retry.attempts).alias("max_attempts"),
                F.lit(d.method).alias("method"),
                mask_url(F.lit(d.url), secrets).alias("url"),
            )
            for d in spec.destinations
        ]
    )
    chosen = F.filter(declared, lambda d: F.array_contains(F.col("routes"), d["id"]))
    rows = events.select(
        F.col("id").alias("event_id"), "created_at", "pipeline_id", "dedupe_key", F.explode(chosen).alias("d")
    )
    return rows.select(
        uuid7_of(F.col("created_at"), F.col("event_id"), F.col("d.id")).alias("id"),
        "created_at",
        "pipeline_id",
        F.col("d.id").alias("destination_id"),
        "event_id",
        "dedupe_key",
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt_count"),
        F.col("d.max_attempts").alias("max_attempts"),
        now.cast("timestamp").alias("next_attempt_at"),
        F.col("d.method").alias("request_method"),
        F.col("d.url").alias("request_url"),
    )


def assert_unique_deliveries(deliveries: DataFrame) -> DataFrame:
    """(event, destination) pairs with more than one delivery; empty when all is well."""
    return (
        deliveries.groupBy("event_id", "destination_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def missing_deliveries(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Events whose deliveries were never written: the repair input after a lost write."""
    routed = events.filter(F.size("routes") > 0)
    known = deliveries.select("created_at", "event_id")
    return routed.join(
        known,
        (routed["id"] == known["event_id"]) & (routed["created_at"] == known["created_at"]),
        "left_anti",
    )
