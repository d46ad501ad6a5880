from __future__ import annotations

import pytest

from sluice.llm.components import components
from sluice.llm.jaccard import near_duplicates, one_of_each_group

from helpers import awkward, edited, frame, lower, prose


def sets_of(text, n):
    w = lower(text).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    """Set size, and the least id reachable, by row."""
    sets = [sets_of(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(
        ((i, len(sets[x]), i if i is None or not sets[x] else least[root(x)]) for x, (i, _) in enumerate(rows)), key=repr
    )


def fixture_rows():
    rows = awkward()
    for g in range(12):
        base = prose(300 + g, 20 + 25 * g)
        rows.append((g * 20, base))
        rows += [(g * 20 + k, edited(base, 31 * g + k, 0.004 * k)) for k in range(1, 12)]
    chain = prose(77, 120).split()
    rows += [(600 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(10)]
    rows += [(700, "A b C"), (701, "a B c"), (702, "a b"), (703, "b a")]
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_groups_against_all_pairs(spark, n, percent):
    rows = fixture_rows()
    got = near_duplicates(frame(spark, rows), n=n, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n, percent)


def test_one_of_each_group_keeps_columns_and_clean_documents(spark):
    rows = fixture_rows()
    docs = frame(spark, rows)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    least = {c for i, size, c in brute(rows, 5, 80) if size and i is not None}
    assert least <= set(ids)
    assert {900, 901, 902} <= set(ids)
    assert len([i for i in ids if i is not None and i < 240]) == len({c for i, _, c in brute(rows, 5, 80) if i is not None and i < 240})


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    assert one_of_each_group(frame(spark, [])).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 151)} | {200: 200, 201: 200}
