from __future__ import annotations

import random

from sluice.llm.substrings import remove_repeats, united
from sluice.llm.words import rightmost_minima

from helpers import awkward, frame, prose, words


def brute(rows, size=50):
    owner: dict = {}
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            owner[key] = min(i, owner.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if i is not None and owner[tuple(w[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def run(spark, rows):
    got = remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    return sorted(map(tuple, got), key=repr)


def test_against_all_windows(spark):
    rng = random.Random(2)
    shared = [prose(100 + i, rng.choice([49, 50, 51, 75, 140])) for i in range(6)]
    rows = awkward()
    for i in range(60):
        parts = [prose(1_000 + i, rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(2_000 + i, rng.randrange(40))]
        rows.append((i, " ".join(parts)))
    rows += [(70, "a b " * 80), (71, "x " + "a b " * 60), (72, "a " * 55)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_passages_over_the_length_are_caught_and_shorter_ones_left(spark):
    passage = prose(1, 51)
    rows = [(1, f"{prose(2, 30)} {passage} {prose(3, 30)}"), (2, f"{prose(4, 30)} {passage} {prose(5, 9)}"), (3, " ".join(passage.split()[:49]))]
    got = remove_repeats(frame(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert [(s.start, s.n) for s in by_id[2].repeats] == [(30, 51)]
    assert by_id[1].n_removed == by_id[3].n_removed == 0


def test_helpers():
    import numpy as np

    assert united([{"start": 5, "n": 5}, {"start": 0, "n": 5}, {"start": 20, "n": 1}]) == [(0, 10), (20, 1)]
    values = np.array([3, 1, 2, 1, 5, 1, 9, 9], np.uint64)
    for width in range(1, 8):
        for s, at in enumerate(rightmost_minima(values, width)):
            window = values[s : s + width].tolist()
            assert at == s + width - 1 - window[::-1].index(min(window))
