"""Bounded-memory dedupe for flows that may forget old keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluice.spec import DedupeSpec


def dedupe_stream(keyed: DataFrame, spec: DedupeSpec, ts: str = "run_created_at") -> DataFrame:
    """Drop repeats of a key seen within `ttl_days`.

    The state forgets keys after that time, so a later repeat counts as new. The
    ledger (`sluice.streaming.intake`) never forgets and is the default.
    """
    marked = keyed.withWatermark(ts, f"{spec.ttl_days} days")
    return marked.dropDuplicatesWithinWatermark(["pipeline_id", "dedupe_key"])
