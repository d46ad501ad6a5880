"""Document fingerprints by winnowing.

Rolling hashes of k words; from each window of `window` hashes the smallest is kept, the rightmost of equal ones, with
its word position. Two texts that share k + window - 1 words in a row share a hash, and the positions say where. A text
with fewer hashes than a window is one window; one with fewer than k words is one gram.

Defined cases: null and empty texts, and texts of white space only, have the empty fingerprint; two empty fingerprints
are alike (1.0), an empty and another are not (0.0); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from sluice.llm.words import chunks, grams, rightmost_minima, small_batches, words

K = 5
WINDOW = 16
BUCKET_ROWS = 2_000
MAX_BUCKETS = 4_000

_U = np.uint64


def winnow(texts: pa.Array, k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the kept hashes (32 bits) and their word positions, by position."""
    w = words(texts)
    gram = grams(w.hashes, k)
    chosen = rightmost_minima(gram, window)
    out = []
    for start, end in zip(w.first[:-1], w.first[1:], strict=True):
        last = end - k - window + 1
        if start <= last:
            at = chosen[start : last + 1]
            at = at[np.append(True, at[1:] != at[:-1])]
        elif start <= end - k:
            own = gram[start : end - k + 1]
            at = np.array([start + len(own) - 1 - int(np.argmin(own[::-1]))])
        elif start < end:
            out.append((grams(w.hashes[start:end], int(end - start)) >> _U(32), np.zeros(1, np.int64)))
            continue
        else:
            at = np.zeros(0, np.int64)
        out.append((gram[at] >> _U(32), at - start))
    return out


def text_form(hashes: np.ndarray, positions: np.ndarray) -> str:
    """`hash@position` by position, hashes as eight hex digits."""
    return " ".join(f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True))


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes."""
    a, b = set(left.tolist()), set(right.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW
) -> DataFrame:
    """Per row the id and `grams`, an array of struct(hash, at): the kept hashes with their word positions."""
    small_batches(docs.sparkSession)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            kept = winnow(batch.column("text"), k, window)
            offsets = np.concatenate([[0], np.cumsum([len(h) for h, _ in kept])]).astype(np.int32)
            struct = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([h for h, _ in kept]).astype(np.int64)),
                    pa.array(np.concatenate([p for _, p in kept]).astype(np.int32)),
                ],
                names=["hash", "at"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=[id_col, "grams"]
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(per_batch, f"`{id_col}` {kind}, grams array<struct<hash: bigint, at: int>>")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, guest, id, text) in id order within buckets of id ranges. Each bucket ends with a guest row, the
    first row of the bucket behind it (in the last, that of the first), so that a row and the next one always meet.

    Only range bounds and the first id of each range come to the driver, at most MAX_BUCKETS of each. Null ids come
    first. Rows of equal id follow each other by a hash of their text.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = int(min(MAX_BUCKETS, 1 + keyed.count() // BUCKET_ROWS))
    bounds: list = []
    if buckets > 1 and isinstance(keyed.schema["id"].dataType, IntegralType):
        steps = [i / buckets for i in range(1, buckets)]
        found = keyed.agg(F.percentile_approx("id", steps, max(10_000, 10 * buckets))).first()[0]
        bounds = sorted(set(found or []))
    elif buckets > 1:
        # Ids of any other type that has an order: every so many-th of a bounded sample of them.
        some = keyed.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(10 * MAX_BUCKETS)
        found = sorted(r[0] for r in some.collect())
        bounds = sorted({found[i * len(found) // buckets] for i in range(1, buckets)}) if found else []

    def numbered(ids: pa.Array) -> list[int]:
        return [0 if i is None else bisect_right(bounds, i) for i in ids.to_pylist()]

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbered(batch.column("id")), pa.int32()), batch.column("id"), batch.column("hash")],
                names=["bucket", "id", "hash"],
            )

    kind = keyed.schema["id"].dataType.simpleString()
    narrow = keyed.select("id", F.xxhash64("text").alias("hash"))
    heads = (
        narrow.mapInArrow(first_keys, f"bucket int, id {kind}, hash bigint")
        .groupBy("bucket")
        .agg(F.min(F.struct("id", "hash")).alias("key"))
        .orderBy("bucket")
        .collect()
    )
    host = {(h.key.id, h.key.hash): heads[i - 1].bucket for i, h in enumerate(heads)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = list(map(host.get, zip(batch.column("id").to_pylist(), batch.column("hash").to_pylist(), strict=True)))
            own = [pa.array(numbered(batch.column("id")), pa.int32()), pa.array([False] * len(hosts))]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns], names=["bucket", "guest", *batch.schema.names])
            at = [i for i, b in enumerate(hosts) if b is not None]
            if at:
                rows = batch.take(pa.array(at))
                extra = [pa.array([hosts[i] for i in at], pa.int32()), pa.array([True] * len(at))]
                yield pa.RecordBatch.from_arrays([*extra, *rows.columns], names=["bucket", "guest", *rows.schema.names])

    schema = f"bucket int, guest boolean, id {kind}, text string, hash bigint"
    rows = keyed.withColumn("hash", F.xxhash64("text")).mapInArrow(placed, schema)
    return rows.repartition(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "guest", "id", "hash")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and that of the next document in id order.

    The edited text has its last quarter (rounded down, in code points) replaced by the first as many code points, or
    all, of the next document; the one after the last is the first. Columns: the id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    small_batches(docs.sparkSession)
    ordered = in_order(docs, id_col, text_col)
    kind = ordered.schema["id"].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(pairs: list[tuple], edited: list[str]) -> pa.RecordBatch:
        own = winnow(pa.array([p[1] for p in pairs] + [p[2] for p in pairs[-1:]], pa.string()), k, window)
        # Neighbours within the list share their fingerprint; where a bucket ends, the next text is a guest's.
        ends = {i: pairs[i][2] for i in range(len(pairs) - 1) if pairs[i][2] is not pairs[i + 1][1]}
        guests = dict(zip(ends, winnow(pa.array(list(ends.values()), pa.string()), k, window), strict=True)) if ends else {}
        changed = winnow(pa.array(edited, pa.string()), k, window)
        columns: list[list] = [[] for _ in names]
        for i, (doc, text, _) in enumerate(pairs):
            mine, other, after = own[i], changed[i], guests.get(i, own[i + 1])
            values = (
                doc,
                len(text),
                hashlib.sha256(edited[i].encode()).hexdigest(),
                text_form(*mine),
                text_form(*other),
                likeness(mine[0], other[0]),
                likeness(mine[0], after[0]),
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    id_type = to_arrow_type(ordered.schema["id"].dataType)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        edited: list[str] = []
        last: tuple | None = None  # the row whose next one has not come yet
        for batch in chunks(batches, "text"):
            for bucket, guest, doc, text in zip(
                *(batch.column(c).to_pylist() for c in ("bucket", "guest", "id", "text")), strict=True
            ):
                text = text or ""
                if last is not None and last[0] == bucket:
                    cut = len(last[2]) // 4
                    pairs.append((last[1], last[2], text))
                    edited.append(last[2][: len(last[2]) - cut] + text[:cut])
                last = None if guest else (bucket, doc, text)
            if pairs:
                yield rows_of(pairs, edited)
                pairs, edited = [], []

    schema = (
        f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return ordered.mapInArrow(per_batch, schema)
