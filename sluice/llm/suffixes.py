"""Exact substring dedup over bytes by a distributed difference-cover sort.

Difference-cover sorting names a sample of all suffixes by sorting triples, recurses on the names, and places every
other suffix by the few characters before the next sampled one. Two equal strings must meet the sample at the same
distance. With a cover by residues two thirds of all positions are sampled; here the cover follows the content: of each
`min_bytes` window the `anchor_bytes` gram with the smallest hash is its anchor, so equal windows have equal anchors at
equal places, and counted from the anchor one position in `stride` is enough.

1. Only strings around an anchor that occurs more than once can repeat. The windows of an anchor form a span. Of equal
   spans one is sorted, with the number of its copies; an anchor whose spans are all equal needs no sorting.
2. Sampled characters (`stride` bytes) are sorted and named. Triples of names are sorted and named again, and so on up
   to names of the longest stretch that lies in every window of the sampled place (168 of 200 bytes).
3. A sampled place whose long name is its own starts no repeat. The others carry the bytes before and after that stretch;
   equal ones are one row. Where these differ, the remaining suffixes (`stride` windows of each) are merged: sorted by
   name, distance to the sample and the bytes around, and each is compared with its neighbours.

All sorts go by range with the spans as last key (`ordered.carried`), so a passage that very many documents share is
spread over tasks.

Defined cases: a null text is empty; equal rows are separate documents (so their texts repeat); rows are told apart by
128 bits of hash over id and text; rows with a null id take part; anchors, spans and ids are compared by 128 bits of
hash, all else by bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.ordered import carried
from sluice.llm.scratch import drop, written
from sluice.llm.words import BYTE_POWERS, _BYTES, buffers, chunks, large_batches, mix, prefix_sums, ranges, signed, small_batches

MIN_BYTES = 200
ANCHOR_BYTES = 64
STRIDE = 24
SCAN_BYTES = 1 << 18
_DOC = ("d1", "d2")
_SPAN = ("anchor", "span")


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the index of its least, the rightmost of equal ones; by the upper 36 bits."""
    size = len(values)
    if size < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    if size > int(low):
        raise ValueError("a text chunk is longer than 2**28 bytes")
    packed = np.full(-(-size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    packed[:size] = (values & ~low) | (low - np.arange(size, dtype=np.uint64))
    blocks = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    least = np.minimum(ahead[: size - width + 1], behind[width - 1 : size])
    return (low - (least & low)).astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.col(id_col).cast("string")
    one, two = F.xxhash64(key, text_col), F.xxhash64(F.lit(1), key, text_col)
    return docs.select(one.alias("d1"), two.alias("d2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def anchor_spans(keyed: DataFrame, min_bytes: int, anchor_bytes: int) -> DataFrame:
    """One row per anchor of a text: the bytes its windows cover (start, n), its place in them (at) and their hash."""
    width = min_bytes - anchor_bytes + 1

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SCAN_BYTES):
            data, bounds = buffers(batch.column("text"))
            if len(data) < min_bytes:
                continue
            sums = prefix_sums(_BYTES[data], BYTE_POWERS)
            size = len(data) - anchor_bytes + 1
            gram = (sums[anchor_bytes:] - sums[:size]) * BYTE_POWERS.down[:size]
            gram ^= gram >> np.uint64(32)
            gram *= np.uint64(0xC2B2AE3D27D4EB4F)
            chosen = window_minima(gram, width)
            whole = np.arange(min_bytes, min_bytes + len(chosen)) <= np.repeat(bounds[1:], np.diff(bounds))[: len(chosen)]
            # Between whole windows of two texts lie others, so a run of windows with one anchor is within one text.
            moved = np.concatenate([[True], chosen[1:] != chosen[:-1], [True]])
            first = np.flatnonzero(whole & (moved[:-1] | ~np.concatenate([[False], whole[:-1]])))
            if not len(first):
                continue
            last = np.flatnonzero(whole & (moved[1:] | ~np.concatenate([whole[1:], [False]])))
            low, high, chosen = first, last + min_bytes, chosen[first]
            text = np.searchsorted(bounds, low, side="right") - 1
            shape = ((high - low) << 20 | (chosen - low)).astype(np.uint64)
            span = mix(ranges(sums, low, high, BYTE_POWERS) + shape * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(text)) for c in _DOC),
                    signed(gram[chosen]),
                    signed(span),
                    *(pa.array(x.astype(np.int32)) for x in (low - bounds[text], high - low, chosen - low)),
                ],
                names=[*_DOC, *_SPAN, "start", "n", "at"],
            )

    return keyed.select(*_DOC, "text").mapInArrow(
        per_batch, "d1 bigint, d2 bigint, anchor bigint, span bigint, start int, n int, at int"
    )


def _hashed(keys: DataFrame) -> DataFrame:
    """Rows of numbers only, one per key: the other side of the join passes by their hash table and is not sorted."""
    return keys.hint("shuffle_hash")


def _pieces(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the given spans; the texts of other documents do not take part in the shuffle's output."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            columns = (batch.column(c) for c in ("text", *_DOC, "spans"))
            for text, d1, d2, spans in zip(*columns, strict=True):
                raw, doc = (text.as_py() or "").encode(), (d1.as_py(), d2.as_py())
                out += [(s["anchor"], s["span"], s["copies"], *doc, s["start"], s["at"], raw[s["start"] : s["start"] + s["n"]]) for s in spans.as_py()]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
                names = [*_SPAN, "copies", *_DOC, "start", "at", "piece"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    spans = F.collect_list(F.struct(*_SPAN, "copies", "start", "n", "at")).alias("spans")
    schema = "anchor bigint, span bigint, copies bigint, d1 bigint, d2 bigint, start int, at int, piece binary"
    return keyed.select(*_DOC, "text").join(wanted.groupBy(*_DOC).agg(spans), list(_DOC)).mapInArrow(cut, schema)


def _regrouped(named: DataFrame) -> DataFrame:
    return named.groupBy(*_SPAN).agg(F.transform(F.array_sort(F.collect_set(F.struct("i", "rank"))), lambda x: x["rank"]).alias("names"))


def _numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `counts[row]` members of every row: the row, and the member's number in it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Strings of bytes that lie one behind the other in `data`, up to `ends[1:]`."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def long_names(pieces: DataFrame, stride: int, strides: int) -> DataFrame:
    """anchor, span, i (number of the sampled place in its span) and name: equal names at equal distance from equal
    anchors mean equal `strides * stride` bytes from there on."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column("piece"))
            at = batch.column("at").to_numpy().astype(np.int64)
            head = np.minimum(at % stride, np.diff(bounds))
            row, i = _numbered(-(-(np.diff(bounds) - head) // stride))
            if not len(row):
                continue
            start = bounds[row] + head[row] + stride * i
            ends = np.concatenate([[0], np.cumsum(np.minimum(start + stride, bounds[row + 1]) - start)])
            # The parts of a piece lie one behind the other, all but the bytes before its first one.
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, bounds[:-1], 1)
            np.add.at(step, bounds[:-1] + head, -1)
            parts = _binary(ends, data[np.cumsum(step[:-1]) == 0])
            keys = (batch.column(c).take(pa.array(row)) for c in _SPAN)
            away = (i - (at // stride)[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(i.astype(np.int32)), pa.array(away), parts], names=[*_SPAN, "i", "away", "part"])

    samples = pieces.select(*_SPAN, "at", "piece").mapInArrow(sampled, "anchor bigint, span bigint, i int, away int, part binary")
    samples = written(samples, "samples")  # a sort by range reads its input twice
    named = carried(samples, ["anchor", "away", "part"], ["span"], name="characters")
    drop(samples)
    reach = 1
    while reach < strides:
        steps = [0, reach, 2 * reach] if 3 * reach <= strides else [0, min(reach, strides - reach), strides - reach]
        spread = _regrouped(named).select(*_SPAN, "names", F.posexplode("names").alias("i", "t0"))
        later = [F.coalesce(F.get("names", F.col("i") + s), F.lit(-1)).alias(f"t{j}") for j, s in enumerate(steps) if j]
        triples = spread.select(*_SPAN, "i", "t0", *later)
        longer = carried(triples, ["t0", "t1", "t2"], list(_SPAN), name="triples")
        drop(named)
        named = longer
        reach = min(3 * reach, strides)
    names = written(named.select(*_SPAN, "i", F.col("rank").alias("name")), "names")
    drop(named)
    return names


def _edges(kept: DataFrame, pieces: DataFrame, stride: int, core: int, min_bytes: int) -> DataFrame:
    """For each sampled place the bytes before (`left` many) and after its long name that its windows reach."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in (*_SPAN, "copies", *_DOC, "start", "at", "piece", "places"))
            for anchor, span, copies, d1, d2, start, at, piece, places in zip(*columns, strict=True):
                for place in places:
                    t = at % stride + stride * place["i"]
                    if t + core > len(piece):
                        continue
                    left, after = piece[max(0, t - stride + 1) : t], piece[t + core : t + min_bytes]
                    out.append((place["name"], len(left), left + after, anchor, span, copies, d1, d2, start + t))
            if out:
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["name", "left", "edge", *_SPAN, "copies", *_DOC, "place"]
    kinds = (pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 5, pa.int32())
    places = kept.groupBy(*_SPAN).agg(F.collect_set(F.struct("i", "name")).alias("places"))
    schema = "name bigint, left int, edge binary, anchor bigint, span bigint, copies bigint, d1 bigint, d2 bigint, place int"
    return pieces.join(places, list(_SPAN)).mapInArrow(around, schema)


def _sorted_suffixes(edges: DataFrame, stride: int, core: int, min_bytes: int) -> DataFrame:
    """The remaining suffixes of every distinct edge, sorted by name, distance to the sample and the bytes around."""

    width = min_bytes - core

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column("edge"))
            left = batch.column("left").to_numpy().astype(np.int64)
            least = np.maximum(0, width - (np.diff(bounds) - left))
            row, i = _numbered(np.maximum(0, left + 1 - least))
            if not len(row):
                continue
            away = least[row] + i
            around = np.lib.stride_tricks.sliding_window_view(data, width)[bounds[row] + left[row] - away]
            keys = (batch.column(c).take(pa.array(row)) for c in ("number", "name"))
            strings = _binary(np.arange(len(row) + 1) * width, around.reshape(-1))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(away.astype(np.int32)), strings], names=["number", "name", "away", "around"])

    rows = edges.select("number", "name", "left", "edge").mapInArrow(suffixes, "number bigint, name bigint, away int, around binary")
    rows = written(rows, "remaining")
    placed = carried(rows, ["name", "away", "around"], ["number"], name="suffixes")
    drop(rows)
    return placed


def _masks(placed: DataFrame) -> DataFrame:
    """Per edge the distances (bits of `mask`) whose suffix has an equal neighbour."""
    repeated = placed.where("nth = 2").select("rank")
    return placed.select("number", "away", "rank").join(_hashed(repeated), "rank").groupBy("number").agg(F.expr("bit_or(shiftleft(1, away))").alias("mask"))


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    anchor_bytes: int = ANCHOR_BYTES,
    stride: int = STRIDE,
) -> DataFrame:
    """Per document with repeats (d1, d2): `whole`, spans of bytes (start, n) that repeat, and `parts`, sampled places
    with a bit for each distance before them at which a string of `min_bytes` starts that also starts elsewhere."""
    if not 1 <= stride <= min(31, min_bytes - anchor_bytes) or min_bytes < 2 * stride:
        raise ValueError("stride must be below 32 and leave room for an anchor and a stretch")
    core = (min_bytes - stride + 1) // stride * stride
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    spans = anchor_spans(keyed, min_bytes, anchor_bytes)
    # Maxima of a span that occurs once are its place; the others get theirs below. (Plain numbers keep it a hash aggregate.)
    place = (*_DOC, "start", "n", "at")
    distinct = written(spans.groupBy(*_SPAN).agg(F.count("*").alias("copies"), *(F.max(c).alias(c) for c in place)), "spans")
    anchors = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unclear = written(distinct.join(_hashed(anchors), "anchor").drop("kinds"), "unclear")
    copied = written(distinct.where("copies > 1").select(*_SPAN), "copied")
    drop(distinct)
    occurrences = written(spans.join(_hashed(copied), list(_SPAN)).select(*_DOC, *_SPAN, "start", "n"), "occurrences")
    drop(copied)
    several = unclear.where("copies > 1").select(*_SPAN, "copies", "n", "at")
    one = several.join(occurrences.drop("n"), list(_SPAN)).groupBy(*_SPAN, "copies", "n", "at").agg(F.min(F.struct(*_DOC, "start")).alias("one"))
    single = unclear.where("copies = 1")
    wanted = single.unionByName(one.select(*_SPAN, "copies", "n", "at", "one.*"))
    pieces = written(_pieces(keyed, wanted), "pieces")
    drop(unclear)
    with large_batches(docs.sparkSession):  # no whole texts from here on
        named = long_names(pieces, stride, core // stride)
        shared = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
        around = written(_edges(named.join(_hashed(shared), "name"), pieces, stride, core, min_bytes), "around")
        drop(pieces, named)
        edges = carried(around, ["name", "left", "edge"], list(_SPAN), name="edges")
        drop(around)
        table, edges = edges, edges.withColumnRenamed("rank", "number")
        different = edges.groupBy("number", "name", "left", "edge").agg(F.sum("copies").alias("total"))
        different = written(different, "different")
        mixed = different.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
        suffixes = _sorted_suffixes(different.join(_hashed(mixed), "name"), stride, core, min_bytes)
    masks = _masks(suffixes)
    everything = F.lit((1 << stride) - 1)
    judged = different.select("number", "total").join(masks, "number", "left")
    judged = judged.select("number", F.when(F.col("total") > 1, everything).otherwise(F.col("mask")).alias("mask")).where("mask is not null")
    single = edges.where("copies = 1").join(judged, "number").select(
        *_DOC, F.col("place").alias("start"), F.lit(None).cast("int").alias("n"), "mask",
        F.least("left", F.lit(stride - 1)).alias("far"), (F.lit(min_bytes - core) - (F.length("edge") - F.col("left"))).alias("near"),
    )
    whole = occurrences.select(
        *_DOC, "start", "n", F.lit(None).cast("int").alias("mask"), F.lit(0).alias("far"), F.lit(0).alias("near")
    )
    found = whole.unionByName(single).groupBy(*_DOC).agg(F.collect_set(F.struct("start", "n", "mask", "far", "near")).alias("found"))
    found = written(found, "found")
    drop(occurrences, table, different, suffixes)
    return found


def covered(size: int, found: list[dict], min_bytes: int) -> np.ndarray:
    """Which of `size` bytes lie in a repeated string."""
    fields = [(c, pa.int32()) for c in ("start", "n", "mask", "far", "near")]
    return covered_in(np.array([size]), pa.array([found], pa.list_(pa.struct(fields))), min_bytes)


def covered_in(sizes: np.ndarray, found: pa.ListArray, min_bytes: int) -> np.ndarray:
    """`covered` for texts of these sizes, one behind the other, with one list each."""
    size, ends = int(sizes.sum()), np.cumsum(sizes)
    counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy()
    flat = found.flatten()
    base = np.repeat(ends - sizes, counts) + flat.field("start").to_numpy(zero_copy_only=False)
    part = flat.field("mask").is_valid().to_numpy(zero_copy_only=False)
    n = flat.field("n").filter(pa.array(~part)).to_numpy().astype(np.int64)
    begin, end = [base[~part]], [base[~part] + n]
    if part.any():
        mask, far, near = (flat.field(c).filter(pa.array(part)).to_numpy().astype(np.int64) for c in ("mask", "far", "near"))
        away = np.arange(far.max() + 1)
        row, away = np.nonzero((mask[:, None] >> away & 1 > 0) & (away >= near[:, None]) & (away <= far[:, None]))
        at = base[part][row] - away
        begin.append(at)
        end.append(at + min_bytes)
    step = np.bincount(np.concatenate(begin), minlength=size + 1)
    step -= np.bincount(np.concatenate(end), minlength=size + 1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    anchor_bytes: int = ANCHOR_BYTES,
    stride: int = STRIDE,
) -> DataFrame:
    """Every document without the bytes that some repeated string of `min_bytes` covers.

    Columns: the id, n_bytes, n_removed, removed (array of start, n: the maximal runs) and kept (the bytes left; a cut
    may fall inside a character, so they are not text).
    """
    keyed = _keyed(docs, id_col, text_col)
    found = repeats(docs, id_col, text_col, min_bytes, anchor_bytes, stride)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, bounds = buffers(batch.column("text"))
            sizes = np.diff(bounds)
            gone = covered_in(sizes, batch.column("found"), min_bytes)
            # A run ends with its text.
            edge = np.zeros(len(data) + 1, bool)
            edge[bounds] = True
            edge[1:-1] |= gone[1:] != gone[:-1]
            at = np.flatnonzero(edge)
            first = at[:-1][gone[at[:-1]]]
            last = at[1:][gone[at[:-1]]]
            text = np.searchsorted(bounds, first, side="right") - 1
            runs = [pa.array(x.astype(np.int32)) for x in (first - bounds[text], last - first)]
            offsets = np.searchsorted(text, np.arange(len(sizes) + 1))
            removed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(runs, ["start", "n"]))
            kept = _binary(np.concatenate([[0], np.cumsum(~gone)])[bounds], data[~gone])
            columns = [pa.array(sizes.astype(np.int64)), removed, kept]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[id_col, "n_bytes", "removed", "kept"])

    kind = keyed.schema["id"].dataType.simpleString()
    result = keyed.join(found, list(_DOC), "left").mapInArrow(
        per_batch, f"`{id_col}` {kind}, n_bytes bigint, removed array<struct<start: int, n: int>>, kept binary"
    )
    return result.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "removed", "kept")
