from __future__ import annotations

import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sluice.llm.mixture import mix, plan_mix

from helpers import awkward, prose, words

SCHEMA = "doc_id long, text string, lang string, source string, tokens long, copies string, rest int"
WEIGHTS = {("a",): 3, ("b",): 1, ("*", "en"): 5, ("a", "de"): 2, ("*", "*", "s1"): 4, ("b", "fr"): 0}


def levels():
    return {"domain": F.when(F.col("source").rlike("[12]"), "a").otherwise("b"), "lang": F.col("lang"), "source": F.col("source")}


def domain(row):
    return "a" if row[3] and ("1" in row[3] or "2" in row[3]) else "b"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)


def corpus():
    rows = []
    for i in range(300):
        lang = ["en", "en", "en", "de", "fr"][i % 5]
        rows.append((i, prose(i, 5 + i % 60), lang, f"s{i % 4}" if i % 3 else "s0"))
    return rows + [(i, t, None, "s9") for i, t in awkward()]


def weight(path):
    best, found = -1, 1
    for key, w in WEIGHTS.items():
        if len(key) == len(path) and all(k in ("*", p) for k, p in zip(key, path)):
            found = w
    del best
    return found


def fill(budget, children, capacity):
    """Shares of children: whoever cannot use its share gets what it can use, the rest is shared anew."""
    shares, open_ = {}, [c for c in children if weight(c) > 0]
    left = budget
    while open_:
        total = sum(weight(c) for c in open_)
        full = [c for c in open_ if capacity[c] * total <= left * weight(c)]
        if not full:
            shares |= {c: left * weight(c) // total for c in open_}
            break
        c = min(full, key=lambda c: (Fraction(capacity[c], weight(c)), c))
        shares[c] = capacity[c]
        left -= capacity[c]
        open_.remove(c)
    return {c: shares.get(c, 0) for c in children}


def brute(rows, share, epochs, hashes, seed=17):
    tokens = {}
    for r in rows:
        path = (domain(r), r[2] or "", r[3] or "")
        key = (r[0], hashes[r[1]], path)
        tokens[key] = tokens.get(key, 0) + len(words(r[1]))
    leaf = {}
    for (_, _, path), n in tokens.items():
        leaf[path] = leaf.get(path, 0) + n
    capacity = {}
    for path, n in leaf.items():
        for d in (1, 2, 3):
            capacity[path[:d]] = capacity.get(path[:d], 0) + n * epochs
    given = {(): int(sum(leaf.values()) * share)}
    for d in (1, 2, 3):
        for parent in {p[: d - 1] for p in leaf}:
            given |= fill(given[parent], sorted({p[:d] for p in leaf if p[: d - 1] == parent}), capacity)
    out = {}
    for path, n in leaf.items():
        full, rest = divmod(given[path], n) if n else (0, given[path])
        order = sorted(
            (hashlib.md5(f"{seed}:{full}:{'' if k[0] is None else k[0]}:{k[1]}".encode()).hexdigest(), str(k[0]), k)
            for k in tokens
            if k[2] == path
        )
        upto = 0
        for _, _, key in order:
            upto += tokens[key]
            out[key] = full + (upto <= rest)
    return out


@pytest.mark.parametrize(("share", "epochs"), [(1.0, 3), (0.4, 1), (2.5, 2)])
def test_against_plain_budgeting(spark, share, epochs):
    rows = corpus()
    docs = frame(spark, rows)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    plan = plan_mix(docs, levels(), WEIGHTS, share, epochs)
    got = {(r.id, r.row, (r.domain, r.lang, r.source)): r.copies for r in plan.collect()}
    want = brute(rows, share, epochs, hashes)
    assert set(got) == set(want)
    wordless = {hashes[t] for t in (None, "", " \t\n ")}
    assert {k: v for k, v in got.items() if k[1] not in wordless} == {k: v for k, v in want.items() if k[1] not in wordless}


def test_mix_repeats_rows_with_their_columns(spark):
    docs = frame(spark, corpus())
    mixed = mix(docs, levels(), WEIGHTS, budget_share=1.0, max_epochs=3)
    assert mixed.columns == docs.columns
    plan = {(r.id, r.row): r.copies for r in plan_mix(docs, levels(), WEIGHTS, 1.0, 3).collect()}
    counts = {}
    for r in mixed.select("doc_id", F.xxhash64("text").alias("h")).collect():
        counts[r.doc_id, r.h] = counts.get((r.doc_id, r.h), 0) + 1
    twice = (905, docs.where("doc_id = 905").select(F.xxhash64("text")).first()[0])
    for key, n in plan.items():
        assert counts.get(key, 0) == n * (2 if key == twice else 1)


def test_empty_table_and_bad_weights(spark):
    assert plan_mix(frame(spark, []), levels(), WEIGHTS).collect() == []
    assert mix(frame(spark, []), levels(), WEIGHTS).collect() == []
    with pytest.raises(ValueError):
        plan_mix(frame(spark, corpus()), levels(), {("a",): -1})


def test_what_an_unweighted_child_leaves_goes_to_the_siblings_of_its_parent(spark):
    """Half of domain b may not be used: its share beyond the other half goes to a, on every level."""
    from sluice.llm.mixture import budgets

    leaves = [("a", "en", "x", 100), ("b", "en", "x", 10), ("b", "en", "y", 40), ("b", "fr", "x", 50)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = budgets(frame, ["domain", "lang", "source"], {("b", "fr"): 0, ("b", "en", "y"): 0}, 100, 1).collect()
    assert {(r.domain, r.lang, r.source): r.budget for r in got} == {
        ("a", "en", "x"): 90, ("b", "en", "x"): 10, ("b", "en", "y"): 0, ("b", "fr", "x"): 0,
    }
