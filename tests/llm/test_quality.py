from __future__ import annotations

import random

from sluice.llm import quality
from sluice.llm.quality import classify

from helpers import awkward, frame, prose


def corpus():
    """Good prose, and junk of three kinds; labels for two thirds."""
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(400):
        good = i % 4 > 0
        text = prose(i, 40 + rng.randrange(80), 4_000)
        if not good:
            text = [" ".join(w + "$$$" for w in text.split()), text.upper().replace(" ", "!! "), "spam " * 60][i // 4 % 3]
        rows.append((i, text))
        truth[i] = int(good)
    return rows, truth


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, text string, id string")


def test_held_out_documents(spark):
    rows, truth = corpus()
    given = labels(spark, [(i, truth[i], "t", "i") for i in truth if i % 5])
    docs = frame(spark, rows)
    got = classify(docs, given)
    assert got.columns[: len(docs.columns)] == docs.columns
    unseen = [r for r in got.collect() if r.doc_id % 5 == 0]
    assert sum(r.keep == bool(truth[r.doc_id]) for r in unseen) / len(unseen) >= 0.97
    assert all(r.keep for r in unseen if truth[r.doc_id])
    assert all(0 <= p <= 1 for r in unseen for p in (r.p_content, r.p_metadata, r.p_quality))


def test_the_sample_bounds_are_respected(spark):
    rows, truth = corpus()
    given = labels(spark, [(i, y, "t", "i") for i, y in truth.items()])
    got = classify(frame(spark, rows), given, labelled_rows=120, pool_rows=60).collect()
    assert sum(r.keep == bool(truth[r.doc_id]) for r in got) / len(got) >= 0.95


def test_awkward_rows_and_labels(spark):
    rows, truth = corpus()
    pairs = [(i, y, "t", "i") for i, y in truth.items()]
    pairs += [(5, 0, "t", "i"), (5, 1, "t", "i"), (None, 1, "t", "i"), (7, None, "t", "i"), (10**9, 0, "t", "i")]
    docs = frame(spark, rows + awkward())
    got = classify(docs, labels(spark, pairs)).collect()
    assert len(got) == len(rows) + len(awkward())
    twice = [r.p_quality for r in got if r.doc_id == 905]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_without_both_classes_all_are_kept(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    for pairs, share in (([], 1.0), ([(1, 1, "t", "i")], 1.0), ([(1, 0, "t", "i")], 0.0)):
        got = classify(docs, labels(spark, pairs)).collect()
        assert [(r.keep, r.p_quality) for r in got] == [(True, share)] * 2
    assert classify(frame(spark, []), labels(spark, [])).collect() == []



def test_every_unlabelled_document_can_give_a_sure_label(spark):
    """The surest documents are found among all, not in a sample of the size that reaches the fit."""
    import numpy as np

    from sluice.llm.quality import Logistic, content_features, surest_rows
    import pyarrow as pa

    rows, truth = corpus()
    narrow = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + [(0, "again")]], "id long, text string, lang string, source string, n_chars long")
    given = spark.createDataFrame([(i, truth[i]) for i in truth if i % 5 == 1], "id long, y int")
    x = content_features(pa.array([t for _, t in rows]))
    model = Logistic.fit(x, np.array([float(truth[i]) for i, _ in rows]))
    none = Logistic(np.zeros(256), np.ones(256), np.zeros(257))
    odds = {i: o for (i, _), o in zip(rows, model.odds(x), strict=True) if i % 5 != 1 and i}
    by_content, by_metadata = surest_rows(narrow, given)((model, none), 7, 20)
    assert by_metadata == []
    for label, n, sign in ((0.0, 7, 1), (1.0, 20, -1)):
        got = sorted(round(sign * odds[i], 6) for i, y, _ in by_content if y == label and i)
        assert got == sorted(round(sign * o, 6) for o in odds.values())[: len(got)] and n - 1 <= len(got) <= n
    assert all(np.allclose(v[0], x[i]) for i, _, v in by_content if i)


def test_kinds_outside_a_sample_are_learned(spark, monkeypatch):
    """A pool of few rows gives the pseudo-labels of the whole table: each round sees every unlabelled document."""
    from sluice.llm import quality

    seen, made = [], quality.surest_rows

    def watched(rows, labels):
        search = made(rows, labels)
        return lambda *a: seen.append(search(*a)) or seen[-1]

    monkeypatch.setattr(quality, "surest_rows", watched)
    rows, truth = corpus()
    given = labels(spark, [(i, truth[i], "t", "i") for i in truth if i % 3])
    classify(frame(spark, rows), given, labelled_rows=120, pool_rows=60).collect()
    chosen = {i for found in seen for side in found for i, _, _ in side}
    assert len(seen) == quality.ROUNDS and 0 < len(chosen) <= 60 and all(i % 3 == 0 for i in chosen)


def test_a_rare_class_is_in_the_sample(spark):
    """One bad label among 400, a sample of 10: the class is neither missed nor the stage switched off."""
    from sluice.llm.quality import quotas, train

    rows, truth = corpus()
    narrow = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "id long, text string, lang string, source string, n_chars long")
    for bad in (0, 4, 8):
        given = spark.createDataFrame([(i, int(i != bad)) for i, y in truth.items() if y or i == bad], "id long, y int")
        model, share = train(narrow, given, 10, 0)
        assert model is not None and share == 300 / 301
    assert quotas({0: 1, 1: 300}, 10) == {0: 1, 1: 9} and quotas({0: 50, 1: 300}, 10) == {0: 5, 1: 5}
    assert quotas({0: 3, 1: 4}, 10) == {0: 3, 1: 4}


def test_columns_named_like_the_results_or_the_inner_ones(spark):
    docs = frame(spark, [(1, "a"), (2, "b")]).selectExpr("*", "'mine' as keep", "1 as p_quality", "2 as _keep", "3 as __lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in quality.classify(docs, labels).collect()] == [True, True]
    rows = quality.kept(docs, labels)
    assert rows.columns == docs.columns and {r.keep for r in rows.collect()} == {"mine"}
