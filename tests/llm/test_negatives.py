from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sluice.llm.negatives import Lists, mine

SCHEMA = "vec_id long, label int, embedding array<float>, id string, row int, shard int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, y, v, "x", 1, 2, 0.5) for i, y, v in rows], SCHEMA)


def brute(rows, asks, positives=5, negatives=5):
    good = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if usable(i, y, v)}
    out = []
    for i, y, v in good:
        if not asks(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            window = [(t, k) for t, k, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(window)]
    return sorted(out)


def usable(i, y, v):
    return i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def run(spark, rows, **sizes):
    return sorted(map(tuple, mine(frame(spark, rows), F.col("vec_id") % 10 == 0, **sizes).collect()))


def clouds(seed, n, dims=6, labels=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((labels, dims)) + 2
    picked = rng.integers(0, labels, n)
    points = (centers[picked] + rng.standard_normal((n, dims))).astype(np.float32)
    return [(i, int(y), p.tolist()) for i, (y, p) in enumerate(zip(picked, points, strict=True))]


def test_against_all_pairs_over_many_shards_and_blocks(spark):
    rows = clouds(1, 300)
    rows += [(400 + i, i % 2, rows[7][2]) for i in range(40)]  # equal vectors: ties go by id
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and run(spark, rows) == want
    assert run(spark, rows, shard_rows=32, block_anchors=4) == want


def test_rows_that_take_no_part_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clouds(2, 60) + clouds(2, 60)[:20]
    bad = [(100, None, rows[0][2]), (None, 1, rows[1][2]), (110, 1, None), (120, 1, [nan] * 6), (130, 1, [inf] + [1.0] * 5)]
    bad += [(140, 1, [None] + [1.0] * 5)]
    assert run(spark, rows + bad) == brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows + [(150, 1, [1.0])]) == brute(rows, lambda i: i % 10 == 0)


def test_few_rows_one_label_zeros_and_empty_tables(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 1, [0.5, -1.0]), (10, 1, [-1.0, -2.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert run(spark, [(i, 4, [float(i), 1.0]) for i in range(30)]) == []
    assert run(spark, [(3, 1, [1.0, 2.0])]) == run(spark, []) == run(spark, [(10, 1, None)]) == []


def test_scores_beyond_double_precision_are_exact_and_saturate(spark):
    rows = [(i, i % 2, [2.0**17 * (i + 1), float(2 * i + 1), -(2.0**10)]) for i in range(24)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert max(r[4] for r in want) > 2**57 and run(spark, rows) == want
    huge = run(spark, [(i, i % 2, [2.0**60, float(i)]) for i in range(14)])
    assert huge and {r[4:] for r in huge} == {(2**63 - 1, 2**63 - 1)}


def test_the_walk_stops_early_on_peaked_rows():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.exponential(1.0, (4_000, 3)) ** 3 * 256)
    lists = Lists(np.arange(4_000), np.zeros(4_000, int), rows)
    anchor, seen, best = rows[17], 0, []
    for new, scores, threshold in lists.walk(anchor):
        seen += len(new)
        best = sorted([*best, *scores.tolist()], reverse=True)[:5]
        if threshold < best[-1]:
            break
    assert seen < 2_000 and best == sorted((rows @ anchor).tolist(), reverse=True)[:5]
