"""Continuous intake: the batch operators inside foreachBatch.

The set of known keys is global and never expires, so it lives in the ledger
and not in stream state. Each micro-batch is one ledger batch, named by its id:
a replayed micro-batch replaces its own partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sluice.plans.run import run_batch
from sluice.session import configure
from sluice.sinks.ledger import Ledger, open_ledger
from sluice.sources.pages import page_documents
from sluice.sources.requests import read_requests, request_documents
from sluice.spec import FlowSpec, PollSource
from sluice.streaming.cycles import hold_cycles

Clock = Callable[[], datetime]


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def documents_of(rows: DataFrame, spec: FlowSpec) -> DataFrame:
    """Documents of a batch of landed pages or requests, by the kind of the flow's source."""
    if isinstance(spec.source, PollSource):
        return page_documents(rows, spec)
    return request_documents(read_requests(rows), spec.id)


def run_stream(
    source: DataFrame,
    spec: FlowSpec,
    ledger: Ledger,
    checkpoint: str,
    clock: Clock = _utc_now,
    route_on: str = "last",
    trigger: dict | None = None,
    hold: timedelta | None = None,
) -> StreamingQuery:
    """Start the intake of a stream of landed pages or requests into a ledger.

    The cuts after a failed or last page look at a poll cycle as a whole. With
    `hold` its pages may land in any order and in several triggers: they wait
    until none has come for that long (see `sluice.streaming.cycles`). Without it
    the pages of a cycle must land together.
    """
    if hold is not None and isinstance(spec.source, PollSource):
        source = hold_cycles(source, hold, late=f"{int(hold.total_seconds())} seconds")

    opened: list[bool] = []

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = configure(batch.sparkSession)
        if not opened:  # once per start: later batches find the tables registered
            open_ledger(spark, ledger)
            opened.append(True)
        name = f"{spec.id}-{batch_id:012d}"
        run_batch(documents_of(batch, spec), spec, ledger, name, clock(), route_on)

    writer = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
