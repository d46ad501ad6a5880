"""Hard-negative mining by the threshold algorithm over per-dimension sorted lists.

Candidates are dealt into shards of a bounded number of rows, anchors into blocks of a bounded number. A task holds one
shard and one block. It sorts the shard once by each dimension. An anchor walks these lists in step, from the top where
its component is positive and from the bottom where it is negative; each row met for the first time is scored in full.
What no list has shown yet scores at most the sum of the anchor's products with the values the lists stand at: the
threshold. The walk ends once the threshold is strictly below the k-th best score, so rows that tie with it are all seen.

First pass: the best rows of the anchor's own label, shards by label, so only these are compared. Second pass: for each
of these positives the best rows of other labels inside its window of scores; the walk ends once the threshold is
strictly below the k-th score of every window, or below the window itself. Each shard gives at most k rows per anchor
and window, of which the k best over all shards are the answer.

Scores are exact: products of integers, in double precision while they stay below 2**53, else as whole numbers of any
length; beyond 64 bits a score counts as the largest or smallest long.

Defined cases: rows with a null id, label or vector, with null or non-finite components (also after scaling) or with
another length than most vectors take no part; rows equal in id, label and vector count once; no row is a partner of an
anchor of its own id; a window below zero is empty; with fewer rows than k all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.scratch import written

SCALE = 256.0
SHARD_ROWS = 4_096
BLOCK_ANCHORS = 2_048
FIRST_DEPTH = 16
DEEPER = 4
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Lists:
    """One shard: its rows in id order, and for each dimension the order of its rows by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.up = np.argsort(self.rows, axis=0, kind="stable")
        self.largest = np.abs(self.rows).max(initial=0)

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows as they are first met, their scores, and the threshold for those not met; minus infinity at the end."""
        size, rows = len(self.ids), self.rows
        used = np.flatnonzero(anchor)
        weights, exact = anchor[used], np.abs(anchor).max(initial=0) * self.largest * max(1, len(anchor)) < _EXACT
        met = np.zeros(size, bool)
        done, depth = 0, FIRST_DEPTH if len(used) else size
        while True:
            end = min(depth, size)
            places = np.arange(done, end)[:, None]
            touched = np.zeros(size, bool)
            touched[self.up[np.where(weights > 0, size - 1 - places, places), used] if end < size else slice(None)] = True
            new = np.flatnonzero(touched & ~met)
            met |= touched
            if not exact:
                scores = np.array([_product(r, anchor) for r in rows[new]], object)
            elif len(new) * 4 > size:  # one product of the whole shard costs less than picking out its rows
                scores = (rows @ anchor)[new]
            else:
                scores = rows[new] @ anchor
            if end == size:
                yield new, scores, -np.inf
                return
            front = rows[self.up[np.where(weights > 0, size - end, end - 1), used], used]
            yield new, scores, float(front @ weights) if exact else _product(front, weights)
            done, depth = end, depth * DEEPER


def _product(a: np.ndarray, b: np.ndarray) -> int:
    return max(-_LONG - 1, min(_LONG, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def positives_of(lists: Lists, anchor: np.ndarray, anchor_id: object, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shard (all of the anchor's label) and scores of its k best other rows."""
    at, scores = np.zeros(0, np.int64), np.zeros(0)
    for new, found, threshold in lists.walk(anchor):
        other = lists.ids[new] != anchor_id
        at, scores = np.concatenate([at, new[other]]), np.concatenate([scores, found[other]])
        keep = _best(scores, lists.ids[at], k)
        at, scores = at[keep], scores[keep]
        if len(at) == k and threshold < scores[-1]:
            break
    return at, scores


def negatives_of(
    lists: Lists, anchor: np.ndarray, anchor_id: object, label: object, tops: list[int], k: int, share: tuple[int, int]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score in `tops` the k best rows of other labels with share * top <= score <= top."""
    numerator, denominator = share
    lows = [-(-numerator * t // denominator) for t in tops]
    found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in tops]
    at, scores = np.zeros(0, np.int64), np.zeros(0)
    live = [i for i, (low, top) in enumerate(zip(lows, tops, strict=True)) if low <= top]
    if not live:
        return found
    ceiling = max(tops[i] for i in live)
    for new, more, threshold in lists.walk(anchor):
        other = (lists.labels[new] != label) & (lists.ids[new] != anchor_id) & (more <= ceiling)
        at, scores = np.concatenate([at, new[other]]), np.concatenate([scores, more[other]])
        if threshold >= ceiling:
            continue
        for i in live:
            inside = np.flatnonzero((scores >= lows[i]) & (scores <= tops[i]))
            keep = inside[_best(scores[inside], lists.ids[at[inside]], k)]
            found[i] = at[keep], scores[keep]
        if all(threshold < (found[i][1][-1] if len(found[i][0]) == k else lows[i]) for i in live):
            break
    return found


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, dims)


def _longs(values: list) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64())


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """Per anchor (a condition on the id column) and positive the hardest negatives.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A negative scores at least
    share[0] / share[1] of the positive and at most as much as it.
    """
    spark = vectors.sparkSession
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    result = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score bigint, negative_score bigint"
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    usable = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), finite.alias("good"))
    usable = usable.where("id is not null and label is not null and vector is not null and good").drop("good").distinct()
    common = usable.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], result)
    dims = common.dims
    rows = written(usable.where(F.size("vector") == dims), "vectors")
    total = rows.count()
    element = rows.schema["vector"].dataType.simpleString()
    anchors = rows.withColumnRenamed("id", id_col).where(is_anchor).withColumnRenamed(id_col, "id")
    blocks = -(-anchors.count() // block_anchors)
    if not blocks:
        return spark.createDataFrame([], result)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    fresh = (F.col(c).alias(c) for c in ("label", "vector"))
    asked = anchors.select(F.col("id").alias("anchor"), F.xxhash64("label", "vector").alias("row"), *fresh, block)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    hashed = F.xxhash64(F.lit(1), "id")

    # First pass: shards within labels; a label has as many as its rows ask for.
    shares = rows.groupBy("label").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    same = rows.join(shares, "label").withColumn("shard", F.pmod(hashed, "shards").cast("int"))
    held = same.select("id", "label", "shard", "vector", every_block)
    wanted = asked.join(shares, "label").select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("anchor", "row", "positive", "score")}
        if left.num_rows and right.num_rows:
            lists = _lists(right, dims)
            for anchor, row, vector in zip(left["anchor"].to_pylist(), left["row"].to_pylist(), _matrix(left["vector"], dims), strict=True):
                at, scores = positives_of(lists, vector, anchor, n_positives)
                out["anchor"] += [anchor] * len(at)
                out["row"] += [row] * len(at)
                out["positive"] += lists.ids[at].tolist()
                out["score"] += scores.tolist()
        kind = left.schema.field("anchor").type
        return pa.table([pa.array(out["anchor"], kind), pa.array(out["row"], pa.int64()), pa.array(out["positive"], kind), _longs(out["score"])], names=list(out))

    best = (
        wanted.groupBy("label", "shard", "block")
        .cogroup(held.groupBy("label", "shard", "block"))
        .applyInArrow(positives, f"anchor {id_type}, row bigint, positive {id_type}, score bigint")
    )
    place = Window.partitionBy("anchor", "row").orderBy(F.desc("score"), "positive")
    chosen = written(best.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= n_positives), "positives")
    tops = chosen.groupBy("anchor", "row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive", "score"))).alias("tops"))

    # Second pass: shards over all rows.
    shards = -(-total // shard_rows)
    open_anchors = asked.join(tops, ["anchor", "row"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    everyone = rows.select("id", "label", "vector", F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"), every_block)

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("anchor", "row", "nth", "positive", "top", "negative", "score")}
        if left.num_rows and right.num_rows:
            lists = _lists(right, dims)
            columns = (left[c].to_pylist() for c in ("anchor", "row", "label", "tops"))
            for anchor, row, label, tops, vector in zip(*columns, _matrix(left["vector"], dims), strict=True):
                windows = negatives_of(lists, vector, anchor, label, [t["score"] for t in tops], n_negatives, share)
                for top, (at, scores) in zip(tops, windows, strict=True):
                    out["anchor"] += [anchor] * len(at)
                    out["row"] += [row] * len(at)
                    out["nth"] += [top["nth"]] * len(at)
                    out["positive"] += [top["positive"]] * len(at)
                    out["top"] += [top["score"]] * len(at)
                    out["negative"] += lists.ids[at].tolist()
                    out["score"] += scores.tolist()
        kind = left.schema.field("anchor").type
        arrays = [pa.array(out["anchor"], kind), pa.array(out["row"], pa.int64()), pa.array(out["nth"], pa.int32()), pa.array(out["positive"], kind)]
        return pa.table([*arrays, _longs(out["top"]), pa.array(out["negative"], kind), _longs(out["score"])], names=list(out))

    schema = f"anchor {id_type}, row bigint, nth int, positive {id_type}, top bigint, negative {id_type}, score bigint"
    found = (
        open_anchors.groupBy("shard", "block").cogroup(everyone.groupBy("shard", "block")).applyInArrow(negatives, schema)
    )
    hardest = Window.partitionBy("anchor", "row", "nth").orderBy(F.desc("score"), "negative")
    ranked = found.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= n_negatives)
    return ranked.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("negative").alias("negative_id"),
        F.col("top").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def _lists(right: pa.Table, dims: int) -> Lists:
    ids, labels = (np.array(right[c].to_pylist()) for c in ("id", "label"))
    return Lists(ids, labels, _matrix(right["vector"], dims))
