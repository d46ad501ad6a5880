"""A whole intake as a job: stage, resolve, write, account."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from sluice.operators.audit import run_facts, run_rows
from sluice.operators.fanout import fan_out
from sluice.plans.intake import plan_intake, shared_folder
from sluice.sinks import files
from sluice.sinks.ledger import (
    Ledger,
    append_deliveries,
    append_events,
    append_runs,
    batch_of,
    compact_events,
    seen_events,
)
from sluice.spec import FlowSpec


def run_batch(
    documents: DataFrame,
    spec: FlowSpec,
    ledger: Ledger,
    batch_id: str,
    now: datetime,
    route_on: str = "last",
) -> DataFrame:
    """Take one batch of documents in; returns the outcome of every item.

    The entries and the resolved keys are written tables, so the later steps
    neither parse again nor depend on executors that are gone. Events go first
    and deliveries are derived from the events written: after a crash in
    between, repeating the batch completes it.
    """
    spark = documents.sparkSession
    staging = shared_folder(spark, ledger.path("staging"))
    newest = ledger.manifest(spark).load()
    if newest.batch != batch_id:
        # The batch before is complete: its staging can go, and it may be merged with others.
        if newest.batch is not None:
            files.remove(spark, f"{staging}/{ledger.name}-{newest.batch}")
        compact_events(spark, ledger)
    plan = plan_intake(
        documents,
        spec,
        now,
        lambda keys: seen_events(keys, ledger, batch_id),
        route_on,
        stage=f"{staging}/{ledger.name}-{batch_id}",
    )
    append_events(plan.events, ledger, batch_id)
    stored = batch_of(spark, ledger, "events", batch_id)
    append_deliveries(fan_out(stored, spec, now), ledger, batch_id)
    trigger = "POLL" if spec.source.origin == "poll" else "ENDPOINT"
    facts = run_facts(plan.entries) if "about" in plan.entries.columns else None
    append_runs(run_rows(plan.outcomes, trigger, facts, now), ledger, batch_id)
    return plan.outcomes
