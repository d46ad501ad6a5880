from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm.neighbours import Tree, chi_square_quantile, nearest

SCHEMA = "vec_id long, embedding array<float>, query string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "q", "c") for i, v in rows], SCHEMA)


def brute(rows, k, asks):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if asks(i):
            scored = sorted(((-float(v @ w), j) for j, w in rows if j != i))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return out


def found(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 16))
    points = centers[rng.integers(0, 6, 900)] + 0.3 * rng.standard_normal((900, 16))
    rows = [(i, points[i].astype(np.float32).tolist()) for i in range(900)]
    return rows + [(1_000 + i, rows[3][1]) for i in range(120)]


def test_recall_scores_and_ranks(spark, clouds):
    got = found(nearest(frame(spark, clouds), F.col("vec_id") % 20 == 0, k=20, cell_rows=64))
    want = brute(clouds, 20, lambda i: i % 20 == 0)
    assert set(got) == set(want)
    hits = 0
    scores = {i: np.array(v, np.float32).astype(float) for i, v in clouds}
    for i, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert [(-s, j) for _, j, s in rows] == sorted((-s, j) for _, j, s in rows)
        assert all(abs(s - scores[i] @ scores[j]) < 1e-9 for _, j, s in rows)
        hits += len({j for _, j, _ in rows} & {j for _, j, _ in want[i]})
    assert hits / (20 * len(want)) >= 0.9


def test_all_candidates_when_few_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (20, [0.5, 0.5])]
    bad = [(40, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (None, [1.0, 1.0])]
    got = found(nearest(frame(spark, good + good[:2] + bad), F.col("vec_id") % 20 == 0, k=20))
    assert got == brute(good, 20, lambda i: i % 20 == 0)


def test_empty_table(spark):
    assert nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(frame(spark, [(1, None)]), F.col("vec_id") % 20 == 0).collect() == []


def test_tree_and_quantile():
    points = np.random.default_rng(1).standard_normal((500, 4))
    tree = Tree(points, 8)
    assert sorted(np.unique(tree.cells(points))) == list(range(8))
    assert Tree(np.ones((9, 2)), 4).cells(np.ones((9, 2))).tolist() == [0] * 9
    assert abs(chi_square_quantile(0.95, 2) + 2 * np.log(0.05)) < 1e-6
    draws = (np.random.default_rng(2).standard_normal((200_000, 8)) ** 2).sum(1)
    assert abs((draws <= chi_square_quantile(0.92, 8)).mean() - 0.92) < 0.005
