"""Membership sketches beside the ledger's files: which bucket of which batch can hold a key.

A sketch is a Bloom filter over one bucket of one batch partition, sized by its rows (20 bits and 8 probes a key, about
one false hit in 10,000). Keys of a new batch meet the sketches of their bucket only, as bitmaps in numpy; what no
sketch holds is new, and the files of the ledger need not be opened for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.dedupe import KEY

BITS_PER_KEY = 20
PROBES = 8
SKETCH_SCHEMA = "bucket int, n_keys bigint, bits bigint, bitmap binary"


def bucket_of(buckets: int) -> Column:
    """The bucket Spark writes a row of a table clustered by `dedupe_key` to."""
    return F.pmod(F.hash("dedupe_key"), F.lit(buckets))


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64(*KEY).alias("h1"), F.xxhash64(F.lit(7), *KEY).alias("h2")


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, one row per probe; `bits` is a power of two."""
    step = h2.view(np.uint64) | np.uint64(1)
    return (h1.view(np.uint64)[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(bits - 1)


def sketches(rows: DataFrame, buckets: int) -> DataFrame:
    """One sketch per bucket of the rows of one batch. A bucket's keys are as many as one file holds."""

    def build(table: pa.Table) -> pa.Table:
        n = table.num_rows
        bits = 1 << max(6, (n * BITS_PER_KEY - 1).bit_length())
        mask = np.zeros(bits, bool)
        mask[_places(table["h1"].to_numpy(), table["h2"].to_numpy(), bits).ravel()] = True
        bitmap = np.packbits(mask, bitorder="little").tobytes()
        return pa.table([[table["bucket"][0].as_py()], [n], [bits], [bitmap]], schema=pa.schema(fields))

    fields = [("bucket", pa.int32()), ("n_keys", pa.int64()), ("bits", pa.int64()), ("bitmap", pa.binary())]
    return rows.select(bucket_of(buckets).alias("bucket"), *_hashes()).groupBy("bucket").applyInArrow(build, SKETCH_SCHEMA)


def hits(keys: DataFrame, stored: DataFrame, buckets: int) -> DataFrame:
    """(key, batch_id, bucket) for every sketch that may hold a key; `stored` are sketches with their batch_id."""

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if asked.num_rows:
            h1, h2 = asked["h1"].to_numpy(), asked["h2"].to_numpy()
            for bits, bitmap, batch in zip(held["bits"].to_pylist(), held["bitmap"], held["batch_id"].to_pylist(), strict=True):
                at = _places(h1, h2, bits)
                raw = np.frombuffer(bitmap.as_buffer(), np.uint8)
                hit = np.flatnonzero((raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(0))
                part = asked.take(pa.array(hit)).select([*KEY, "bucket"])
                found.append(part.append_column("batch_id", pa.array([batch] * len(hit), pa.string())))
        return pa.concat_tables(found) if found else asked.slice(0, 0).select([*KEY, "bucket"]).append_column("batch_id", pa.array([], pa.string()))

    asked = keys.select(*KEY, bucket_of(buckets).alias("bucket"), *_hashes())
    grouped = asked.groupBy("bucket").cogroup(stored.select("bucket", "bits", "bitmap", "batch_id").groupBy("bucket"))
    return grouped.applyInArrow(probe, "pipeline_id string, dedupe_key string, bucket int, batch_id string")
