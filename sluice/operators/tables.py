"""Small tables made from specs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sluice.spec import FlowSpec

# Up to this size a table is broadcast, beyond it the join is left to the optimizer.
BROADCAST_BYTES = 8 << 20
# A row of an id, an instant and a flag, as it is held in memory, with room to spare.
KEY_ROW_BYTES = 256

DESTINATION_SCHEMA = (
    "pipeline_id string, destination_id string, spec_method string, spec_url string, "
    "spec_headers map<string,string>, lease_seconds int, success_statuses array<int>, "
    "persist_body string, retry_initial_ms int, retry_max_ms int, retry_factor double, "
    "retry_jitter double, retry_exponential boolean"
)


def spec_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> tuple[DataFrame, bool]:
    """(frame, small enough to broadcast): specs carry headers and URLs, so their text is measured."""
    size = sum(len(repr(row)) for row in rows)
    return spark.createDataFrame(list(rows), schema), size <= BROADCAST_BYTES


def keys_fit(rows: int) -> bool:
    """Whether so many key rows may be broadcast."""
    return rows * KEY_ROW_BYTES <= BROADCAST_BYTES


def destination_rows(specs: Sequence[FlowSpec]) -> list[tuple]:
    return [
        (
            spec.id,
            d.id,
            d.method,
            d.url,
            dict(d.headers),
            d.lease_seconds,
            list(d.success_statuses),
            d.persist_body,
            d.retry.initial_delay_ms,
            d.retry.max_delay_ms,
            float(d.retry.factor),
            float(d.retry.jitter),
            d.retry.backoff == "exponential",
        )
        for spec in specs
        for d in spec.destinations
    ]
