"""Rendered requests as a sink: rows an outside sender picks up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_requests(rendered: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Write the sendable requests as files."""
    rendered.filter(F.col("err_reason").isNull()).write.mode(mode).format(fmt).save(path)


def as_messages(rendered: DataFrame) -> DataFrame:
    """Key, value and headers as a Kafka sink takes them (write with format("kafka"))."""
    pairs = F.transform(
        F.map_entries("headers"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")),
    )
    return rendered.filter(F.col("err_reason").isNull()).select(
        F.col("delivery_id").cast("binary").alias("key"),
        F.col("body").cast("binary").alias("value"),
        pairs.alias("headers"),
    )
