"""Approximate nearest neighbours by stable random projections and a kd-tree.

Vectors are extended by one coordinate so that the largest inner product is the smallest distance, and projected with
Gaussian numbers to few dimensions. Squared projected distance over squared distance then follows a chi-square law with
as many degrees of freedom. A kd-tree over the projections, fitted on a bounded sample, gives cells; every vector goes
to its cell. A query first verifies the cells nearest in projection and so gets the distance of its k-th best. It may
stop at cells whose projected distance exceeds that distance by the chi-square quantile: a nearer vector would lie there
with probability below 1 - confidence only. The cells before that are verified too, in full, on the original vectors.

Equal vectors would fill one cell without end. Of each distinct vector only the k + 1 smallest ids can be in an answer,
since equal scores go by id; the others are left out of the cells, which changes no answer.

Defined cases: rows with a null id, or a vector that is null, empty, zero, holds null or non-finite components or has
another length than most vectors, take no part; rows of equal id and vector count once; a row is no neighbour of a query
of its own id; with fewer candidates than k all are returned; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.scratch import written

PROJECTED = 8
CONFIDENCE = 0.92
SAMPLE_ROWS = 20_000
CELL_ROWS = 1_024
PROBES = 3
GROUP_QUERIES = 4_096
SEED = 7


def chi_square_quantile(p: float, freedom: int) -> float:
    """Value a chi-square variable with an even number of degrees of freedom stays below with probability p."""
    if freedom % 2:
        raise ValueError("use an even number of projected dimensions")

    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))

    low, high = 0.0, 1_000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


class Tree:
    """kd-tree over projected points: halves at the median of the widest dimension down to `cells` leaves."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.split: list[tuple[int, float, int, int]] = []
        self.root = self._grow(points, max(1, cells), iter(range(1 << 30)))

    def _grow(self, points: np.ndarray, cells: int, numbers: Iterator[int]) -> int:
        """Node index, or a leaf's number as its complement."""
        if cells > 1 and len(points) > 1:
            spread = points.max(0) - points.min(0)
            axis = int(np.argmax(spread))
            cut = float(np.median(points[:, axis]))
            left = points[:, axis] < cut
            if left.any():
                node = len(self.split)
                self.split.append((axis, cut, 0, 0))
                low = self._grow(points[left], cells // 2, numbers)
                high = self._grow(points[~left], cells - cells // 2, numbers)
                self.split[node] = (axis, cut, low, high)
                return node
        return ~next(numbers)

    def cells(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = ~node
                continue
            axis, cut, low, high = self.split[node]
            left = points[rows, axis] < cut
            stack += [(low, rows[left]), (high, rows[~left])]
        return out


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows that take part as id, vector, and the length of their vectors."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), finite.alias("finite")).where(
        F.col("id").isNotNull() & F.col("finite") & F.exists("vector", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths.dims if lengths else 0
    return rows.where(F.size("vector") == dims).select("id", "vector"), dims


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    confidence: float = CONFIDENCE,
    projected: int = PROJECTED,
    sample_rows: int = SAMPLE_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """For each row that `is_query` (a condition on the id column) the k rows of largest inner product.

    Columns: query_id, rank (from 1), the id, score. `sample_rows` bounds what the tree is fitted on; every row is
    indexed. `confidence` is the chance that the stopping test keeps any one true neighbour in reach.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    usable, dims = _usable(vectors, id_col, vector_col)
    empty = f"query_id {kind}, rank int, `{id_col}` {kind}, score double"
    if not dims:
        return spark.createDataFrame([], empty)
    rows = usable.distinct()
    norm = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    total, largest = rows.agg(F.count("*"), F.max(norm)).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()

    gauss = np.random.Generator(np.random.PCG64(SEED)).standard_normal((dims + 1, projected))

    def project(matrix: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(matrix)) if query else np.sqrt(np.maximum(largest - (matrix**2).sum(1), 0.0))
        return np.column_stack([matrix, rest]) @ gauss

    tree = Tree(project(_matrix(sample.column("vector"), dims), False), -(-total // cell_rows))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = project(_matrix(batch.column("vector"), dims), False)
                columns = [pa.array(tree.cells(points)), pa.array(list(points), pa.list_(pa.float64())), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "point", "id", "vector"])

    element = usable.schema["vector"].dataType.simpleString()
    distinct = Window.partitionBy("vector").orderBy("id")
    kept = rows.withColumn("nth", F.row_number().over(distinct)).where(F.col("nth") <= k + 1).drop("nth")
    indexed = written(
        kept.select("id", "vector").mapInArrow(assign, f"cell int, point array<double>, id {kind}, vector {element}"), "cells"
    )
    boxes = (
        indexed.groupBy("cell")
        .agg(*(f(F.get("point", F.lit(i))) for f in (F.min, F.max) for i in range(projected)))
        .orderBy("cell")
        .collect()
    )
    numbers = np.array([b[0] for b in boxes], np.int32)
    lows = np.array([b[1 : projected + 1] for b in boxes], float)
    highs = np.array([b[projected + 1 :] for b in boxes], float)
    reach = chi_square_quantile(confidence, projected)
    name = f"query {kind}, vector {element}, best double"

    def route(batches: Iterator[pa.RecordBatch], further: bool) -> Iterator[pa.RecordBatch]:
        """Rows for the cells to verify: the nearest ones first, then those before the stop."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                matrix = _matrix(batch.column("vector"), dims)
                points = project(matrix, True)[:, None, :]
                gap = np.maximum(np.maximum(lows - points, points - highs), 0.0)
                away = (gap**2).sum(2)
                near = np.argsort(away, axis=1, kind="stable")[:, :PROBES]
                wanted = np.zeros(away.shape, bool)
                np.put_along_axis(wanted, near, True, axis=1)
                if further:
                    best = batch.column("best").to_numpy(zero_copy_only=False)
                    distance = np.maximum((matrix**2).sum(1) + largest - 2 * best, 0.0)
                    wanted = ~wanted & ((away <= reach * distance[:, None]) | np.isneginf(best)[:, None])
                query, cell = np.nonzero(wanted)
                rows = batch.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[cell]), *rows.columns], names=["cell", *rows.schema.names])

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one cell: per query the k best vectors that are no worse than what it has."""
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids = np.array(right.column("id").to_pylist())
            order = np.argsort(ids, kind="stable")
            ids, table = ids[order], _matrix(right.column("vector"), dims)[order]
            queries, best = np.array(left.column("query").to_pylist()), left.column("best").to_numpy()
            matrix = _matrix(left.column("vector"), dims)
            for at in range(0, len(queries), 256):
                scores = matrix[at : at + 256] @ table.T
                scores[queries[at : at + 256, None] == ids] = -np.inf
                for i, row in enumerate(scores):
                    cut = max(best[at + i], np.partition(row, -k)[-k] if len(row) > k else -np.inf)
                    # Products of a matrix may round by place: what is near the cut is summed again, row by row alike.
                    found = np.flatnonzero((row >= cut - 1e-9 * (1 + abs(cut))) & (row > -np.inf))
                    exact = (table[found] * matrix[at + i]).sum(1)
                    first = np.argsort(-exact, kind="stable")[:k]
                    out.append((np.repeat(queries[at + i], len(first)), ids[found[first]], exact[first]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        id_type = left.schema.field("query").type
        return pa.table({"query": pa.array(columns[0], id_type), "id": pa.array(columns[1], id_type), "score": pa.array(columns[2], pa.float64())})

    def search(queries: DataFrame, further: bool) -> DataFrame:
        routed = written(queries.mapInArrow(lambda b: route(b, further), f"cell int, {name}"), "routed")
        counts = routed.groupBy("cell").count()
        salts = counts.select("cell", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / GROUP_QUERIES).cast("int"))).alias("salt"))
        shares = counts.select("cell", (F.floor((F.col("count") - 1) / GROUP_QUERIES) + 1).alias("shares"))
        dealt = routed.join(shares, "cell").withColumn("salt", F.pmod(F.xxhash64("query"), "shares").cast("int")).drop("shares")
        held = indexed.select("cell", "id", "vector").join(salts, "cell")
        return (
            dealt.groupBy("cell", "salt")
            .cogroup(held.groupBy("cell", "salt"))
            .applyInArrow(verify, f"query {kind}, id {kind}, score double")
        )

    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)

    asked = rows.withColumnRenamed("id", id_col).where(is_query).select(F.col(id_col).alias("query"), "vector")
    first = written(top(search(asked.withColumn("best", F.lit(float("-inf"))), False)), "first")
    kth = first.where(F.col("rank") == k).select("query", F.col("score").alias("best"))
    second = search(
        asked.join(kth, "query", "left").select("query", "vector", F.coalesce("best", F.lit(float("-inf"))).alias("best")), True
    )
    merged = top(first.select("query", "id", "score").unionByName(second).dropDuplicates(["query", "id", "score"]))
    return merged.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
