"""Delivery as a job with stored state: results in, reap, reconcile, claim, render, store.

The state of all deliveries is a keyed table (`sluice.sinks.keyed`), one part per month, open and closed rows apart. A
cycle reads the open rows only and stores only the rows it changed. Its requests are a table of their own, one folder per
cycle; an outside sender picks them up and brings the results to the next cycle.

A cycle that is repeated (the same name, results and instant) starts from the state before it and writes the same rows:
ids and lease tokens are derived, not drawn.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.dates import month_partition
from sluice.operators import delivery
from sluice.operators.delivery import DELIVERY_COLUMNS, OPEN, as_deliveries
from sluice.plans.intake import staged
from sluice.sinks import files
from sluice.sinks.keyed import KeyedTable, changed_rows, tagged
from sluice.sinks.manifest import Version
from sluice.spec import FlowSpec

STATE_SCHEMA = ", ".join(f"{c} {t}" for c, t in DELIVERY_COLUMNS.items()) + ", created_month string, state string"
# A step that changes a row changes one of these.
_TAGS = ("status", "attempt_count", "lease_token", "next_attempt_at", "updated_at")
OPEN_STATE, CLOSED_STATE = "open", "closed"


@dataclass(frozen=True)
class CycleLimits:
    """Bounds of one cycle: age of a delivery, leases to reap, deliveries to claim."""

    lookback_days: int = 90
    reap: int = 500
    claim: int = 5_000
    grace_seconds: int = 0


def delivery_store(spark: SparkSession, root: str, fan: int = 4) -> KeyedTable:
    return KeyedTable(spark, f"{root.rstrip('/')}/deliveries", STATE_SCHEMA, ("id",), "created_month", "state", fan)


def with_state(deliveries: DataFrame) -> DataFrame:
    """Adds the month and whether the row is open, which place it in the store."""
    state = F.when(F.col("status").isin(*OPEN), OPEN_STATE).otherwise(CLOSED_STATE)
    return deliveries.withColumns({"created_month": month_partition(F.col("created_at")), "state": state})


def add_deliveries(store: KeyedTable, rows: DataFrame, batch: str) -> Version:
    """Store the deliveries an intake made; repeating the batch replaces it while it is the newest."""
    return store.upsert(batch, with_state(as_deliveries(rows)))


def run_cycle(
    store: KeyedTable,
    events: DataFrame,
    specs: Sequence[FlowSpec],
    cycle: str,
    now: datetime,
    worker: str,
    outcomes: DataFrame | None = None,
    limits: CycleLimits = CycleLimits(),
) -> DataFrame:
    """One cycle over the stored deliveries; returns the requests to send (the folder requests/<cycle>).

    Order: results of earlier attempts, leases that ran out, destinations that are gone, then the claim of what is due
    and its rendering. What cannot be rendered ends here as INVALID_PAYLOAD.
    """
    _, start = store.manifest.start_of(cycle)
    oldest = f"{now - timedelta(days=limits.lookback_days):%Y%m}"
    folder = f"{store.root}/work/{cycle}"
    deliveries = tagged(store.read(start, OPEN_STATE), _TAGS, "_before")
    if outcomes is not None:
        # Written, so that the search for lost leases reads what routes a result, and no bodies.
        results = staged(delivery.held_results(deliveries, outcomes), f"{folder}/results")
        deliveries = delivery.apply_results(deliveries, results, now, specs)
    deliveries = delivery.reap(deliveries, now, limits.lookback_days, limits.reap).drop("reaped")
    deliveries = delivery.reconcile_spec(deliveries, specs, now).drop("action")
    # Written, so that neither the claim nor the rendering repeats what came before.
    deliveries = staged(deliveries, f"{folder}/settled")
    due = delivery.drain_candidates(
        deliveries.filter(F.col("created_month") >= oldest), now, limits.grace_seconds, limits.lookback_days, limits.claim
    )
    deliveries = staged(delivery.claim(deliveries, now, worker, specs, due), f"{folder}/claimed")
    claimed = deliveries.filter("claimed")
    rendered = staged(delivery.render_requests(claimed, events, specs), f"{store.root}/requests/{cycle}")
    after = delivery.discard_invalid(deliveries.drop("claimed"), rendered, now)
    store.upsert(cycle, with_state(changed_rows(after, _TAGS, "_before")))
    store.compact()
    files.remove(store.spark, folder)
    return rendered.filter(F.col("err_reason").isNull())

