"""Parallelism of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


# Above this an input is left as its splits are: moving it would cost more than idle cores.
SPREAD_BYTES = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rebalance a small input over the cores, before its bodies are parsed.

    The size is what the files say; a larger input is never shuffled for this.
    """
    if rows.isStreaming:
        return rows
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
