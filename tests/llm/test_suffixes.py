from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import suffixes
from sluice.llm.suffixes import covered, covered_in, repeats, window_minima, without_repeats

from helpers import awkward, edited, frame, prose


def brute(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + size] for _, b in texts for p in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(gone)))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, **sizes):
    got = without_repeats(frame(spark, rows), **sizes).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got), key=repr)


def corpus():
    rng = random.Random(4)
    shared = [prose(100 + i, rng.choice([30, 45, 60, 75, 140]), 5_000) for i in range(8)]
    rows = awkward()
    for i in range(80):
        parts = [prose(1_000 + i, rng.randrange(90), 5_000)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(40) :], prose(2_000 + i, rng.randrange(40), 5_000)]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, edited(shared[4], i, 0.05)) for i in range(20)]
    return rows + [(70, "a b " * 80), (71, "x " + "a b " * 60), (72, "a" * 230), (73, prose(9, 60) + "|" + prose(9, 60)), (74, "é" * 150)]


@pytest.mark.parametrize("sizes", [(200, 64, 24), (30, 9, 4)])
def test_against_all_strings(spark, sizes):
    rows = corpus()
    size, anchor, stride = sizes
    assert run(spark, rows, min_bytes=size, anchor_bytes=anchor, stride=stride) == brute(rows, size)


def test_one_passage_in_very_many_documents(spark):
    """The passage starts and ends elsewhere in each: every border has to be merged suffix by suffix."""
    passage = prose(1, 80)
    rows = [(i, f"{prose(10 + i, 40)[: 20 + i % 50]}{passage[i % 40 :]}{prose(900 + i, 40)[: 10 + i % 70]}") for i in range(150)]
    assert run(spark, rows) == brute(rows, 200)


def test_empty_table_and_settings(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, b""), (2, 0, 0, 0, b"")]
    with pytest.raises(ValueError):
        repeats(frame(spark, []), min_bytes=40, anchor_bytes=38, stride=8)


def test_window_minima():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 6, 200).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 64, 200, 201):
        want = [s + width - 1 - int(np.argmin(values[s : s + width][::-1])) for s in range(200 - width + 1)]
        assert window_minima(values, width).tolist() == want


def test_covered_places():
    """Both kinds of places, bit by bit; distances beyond `near` and `far` do not count."""
    rng = random.Random(5)
    for _ in range(50):
        found = [{"start": s, "n": rng.randrange(10, 40), "mask": None, "far": 0, "near": 0} for s in rng.sample(range(60), rng.randrange(3))]
        for s in rng.sample(range(30, 60), rng.randrange(4)):
            found.append({"start": s, "n": None, "mask": rng.randrange(1 << 8), "far": rng.randrange(8), "near": rng.randrange(-3, 8)})
        want = np.zeros(100, bool)
        for f in found:
            for away in range(8):
                if f["mask"] is None:
                    want[f["start"] : f["start"] + f["n"]] = True
                elif f["mask"] >> away & 1 and f["near"] <= away <= f["far"]:
                    want[f["start"] - away : f["start"] - away + 30] = True
        assert (covered(100, found, 30) == want).all()


def test_passes_over_short_rows_take_large_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    plain = suffixes.carried
    monkeypatch.setattr(suffixes, "carried", lambda *a, **k: seen.append(int(spark.conf.get(key))) or plain(*a, **k))
    rows = [(i, prose(1, 60) + prose(50 + i, 20)) for i in range(4)]
    assert run(spark, rows) == brute(rows, 200)
    assert seen and set(seen) == {10_000} and int(spark.conf.get(key)) <= 1_000


def test_covered_places_of_many_texts_at_once():
    sizes, whole, part = [50, 0, 40, 45], {"n": 30, "mask": None, "far": 0, "near": 0}, {"n": None, "far": 5, "near": 1}
    found = [[{"start": 20, **whole}], None, [{"start": 0, **whole}], [{"start": 6, "mask": 0b11, **part}, {"start": 12, "mask": 0b100, **part}]]
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "n", "mask", "far", "near")]))
    want = [covered(n, f or [], 30) for n, f in zip(sizes, found, strict=True)]
    shifted = pa.array([[{"start": 1, **whole}], *found], kind)[1:]
    assert (covered_in(np.array(sizes), shifted, 30) == np.concatenate(want)).all()
    assert [int(w.sum()) for w in want] == [30, 0, 30, 35]


def test_runs_end_with_their_texts(spark):
    text = prose(7, 60)
    rows = [(1, text), (2, ""), (3, text), (4, "x"), (5, None), (6, text + "é")]
    assert run(spark, rows) == brute(rows, 200)


def test_key_joins_do_not_sort_the_spans(spark, monkeypatch):
    plans, plain = {}, suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda f, name: plans.update({name: f._jdf.queryExecution().toString()}) or plain(f, name))
    rows = [(i, prose(1, 60) + prose(50 + i, 20)) for i in range(4)]
    assert run(spark, rows) == brute(rows, 200)
    for name in ("unclear", "occurrences", "around"):
        assert "strategy=shuffle_hash" in plans[name]
