"""Substring dedup by seed and extend.

Seeds are winnowed word grams: of the grams in a window of `min_words` words the one with the smallest hash (the
rightmost of equal ones) is its anchor, so equal windows have equal anchors. Anchors are joined across documents. An
anchor is extended both ways over all windows that chose it, at most `min_words` each way; its extension counts as
repeated when a smaller document has the same words around that anchor. The first documents with an extension are
compared window by window, if their anchor has other extensions too. Touching and overlapping repeats are united into
maximal ones.

Nothing is paired within a group: each step is an aggregate by anchor or by window, with map-side reduction, and a join
back that the optimizer may split when a key is hot.

Defined cases: a null text is empty; a null id neither removes nor is removed from; rows of equal id never remove from
each other; equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.scratch import drop, written
from sluice.llm.words import (
    SPAN_POWERS,
    WORD_POWERS,
    chunks,
    grams,
    mix,
    prefix_sums,
    ranges,
    rightmost_minima,
    signed,
    small_batches,
    words,
)

MIN_WORDS = 50
ANCHOR_WORDS = 8


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and a hash that tells rows of equal id apart."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def _type_of(frame: DataFrame, name: str) -> str:
    return frame.schema[name].dataType.simpleString()


def anchor_spans(keyed: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """One row per anchor: the span of words its windows cover, the anchor's hash and a hash of the whole span."""
    width = min_words - anchor_words + 1

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            w = words(batch.column("text"))
            gram = grams(w.hashes, anchor_words)
            chosen = rightmost_minima(gram, width)
            if not len(chosen):
                continue
            starts = np.arange(len(chosen))
            text = w.text_of(starts)
            whole = starts + min_words <= w.first[text + 1]
            starts, text, chosen = starts[whole], text[whole], chosen[whole]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            low, high = starts[at], starts[np.append(at[1:], len(starts)) - 1] + min_words
            text, chosen = text[at], chosen[at]
            sums = prefix_sums(w.hashes, SPAN_POWERS)
            span = ranges(sums, low, high, SPAN_POWERS)
            shape = ((high - low) << 20 | (chosen - low)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(text)),
                    batch.column("row").take(pa.array(text)),
                    signed(gram[chosen]),
                    signed(mix(span + shape * np.uint64(0x9E3779B97F4A7C15))),
                    pa.array((low - w.first[text]).astype(np.int32)),
                    pa.array((high - low).astype(np.int32)),
                ],
                names=["id", "row", "anchor", "span", "start", "n"],
            )

    schema = f"id {_type_of(keyed, 'id')}, row bigint, anchor bigint, span bigint, start int, n int"
    return keyed.where("id is not null").mapInArrow(per_batch, schema)


def _windows(keyed: DataFrame, spans: DataFrame, min_words: int) -> DataFrame:
    """The windows of the given spans, each with 128 bits of hash."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            w = words(batch.column("text"))
            spans = batch.column("spans")
            lengths = pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(spans)), lengths)
            flat = spans.flatten()
            low = flat.field("start").to_numpy() + w.first[text]
            count = flat.field("n").to_numpy() - min_words + 1
            text = np.repeat(text, count)
            inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(low, count) + inner
            sums, more = prefix_sums(w.hashes, SPAN_POWERS), prefix_sums(w.hashes, WORD_POWERS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(text)),
                    batch.column("row").take(pa.array(text)),
                    signed(ranges(sums, at, at + min_words, SPAN_POWERS)),
                    signed(ranges(more, at, at + min_words, WORD_POWERS)),
                    pa.array((at - w.first[text]).astype(np.int32)),
                ],
                names=["id", "row", "w1", "w2", "start"],
            )

    wanted = spans.groupBy("id", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    schema = f"id {_type_of(keyed, 'id')}, row bigint, w1 bigint, w2 bigint, start int"
    return keyed.join(wanted, ["id", "row"]).mapInArrow(per_batch, schema)


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    anchor_words: int = ANCHOR_WORDS,
) -> DataFrame:
    """Per document with repeats: `id`, `row` (xxhash64 of its text) and `spans`, the word ranges that some window of
    `min_words` words covers which a document of smaller id also has. Ranges may overlap."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    spans = anchor_spans(keyed, min_words, anchor_words)
    # Written, so that the joins have plain exchanges and a hot anchor can be split between tasks.
    kinds = written(spans.groupBy("anchor", "span").agg(F.min("id").alias("first"), F.max("id").alias("last")), "kinds")
    anchors = kinds.groupBy("anchor").agg(F.min("first").alias("a"), F.max("last").alias("z"), F.count("*").alias("n_kinds"))
    anchors = anchors.where("a < z").select("anchor", (F.col("n_kinds") > 1).alias("differ"))
    seeds = written(kinds.join(anchors, "anchor").select("anchor", "span", "first", "differ"), "seeds")
    drop(kinds)
    # Behind the first document with a span all others repeat it whole. The first ones are compared window by window,
    # where their anchor has other spans too.
    same = F.col("id") > F.col("first")
    joined = written(
        spans.join(seeds, ["anchor", "span"]).where(same | F.col("differ")).select("id", "row", "start", "n", same.alias("same")),
        "anchors",
    )
    drop(seeds)
    windows = written(_windows(keyed, joined.where(~F.col("same")), min_words), "windows")
    owners = (
        windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    )
    later = windows.join(owners, ["w1", "w2"]).where(F.col("first") < F.col("id"))
    found = joined.where("same").select("id", "row", "start", "n").unionByName(
        later.select("id", "row", "start", F.lit(min_words).alias("n"))
    )
    found = written(found.groupBy("id", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "found")
    drop(joined, windows)
    return found


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    anchor_words: int = ANCHOR_WORDS,
) -> DataFrame:
    """Every document without its repeated words.

    Columns: the id, n_words, n_removed, repeats (array of start, n: maximal word ranges removed) and kept_text (the
    words left, joined by single spaces).
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col, min_words, anchor_words)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n_words, n_removed, repeats, kept = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                parts = (text.as_py() or "").encode().split()
                runs = united(found.as_py() or [])
                at, left = 0, []
                for start, n in runs:
                    left += parts[at:start]
                    at = start + n
                left += parts[at:]
                n_words.append(len(parts))
                n_removed.append(len(parts) - len(left))
                repeats.append([{"start": s, "n": n} for s, n in runs])
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))),
                    pa.array(kept, pa.string()),
                ],
                names=[id_col, "n_words", "n_removed", "repeats", "kept_text"],
            )

    schema = (
        f"`{id_col}` {_type_of(keyed, 'id')}, n_words bigint, n_removed bigint, "
        "repeats array<struct<start: int, n: int>>, kept_text string"
    )
    return keyed.join(spans, ["id", "row"], "left").mapInArrow(per_batch, schema)


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as maximal ones, in order."""
    out: list[list[int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [(a, b - a) for a, b in out]
