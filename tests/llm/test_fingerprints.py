from __future__ import annotations

import hashlib

import pyarrow as pa

from sluice.llm.fingerprints import fingerprints, with_next, winnow

from helpers import awkward, edited, frame, prose


def test_edited_text_next_document_and_likeness(spark):
    rows = [(i, prose(i, 5 + 7 * i)) for i in range(1, 40)] + [(100, None), (101, "é" * 9), (102, "")]
    got = {r.doc_id: r for r in with_next(frame(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    assert len(got) == len(rows)
    for at, (i, _) in enumerate(rows):
        own, after = texts[at], texts[(at + 1) % len(rows)]
        cut = len(own) // 4
        changed = own[: len(own) - cut] + after[:cut]
        assert got[i].n_chars == len(own)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[38].near_edited > 0.4 > got[38].near_next
    assert got[100].fingerprint == got[102].fingerprint == ""


def test_awkward_rows_come_back_each_once(spark):
    rows = awkward()
    got = with_next(frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    twice = [r.fingerprint for r in got if r.doc_id == 905]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_many_buckets(spark, monkeypatch):
    from sluice.llm import fingerprints as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 5)
    rows = [(3 * i, prose(i, 20)) for i in range(47)]
    got = {r.doc_id: r.edited_sha256 for r in with_next(frame(spark, rows)).collect()}
    for at, (i, own) in enumerate(rows):
        after, cut = rows[(at + 1) % len(rows)][1], len(own) // 4
        assert got[i] == hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest()


def test_shared_runs_share_a_hash_at_known_places():
    run = prose(1, 20)
    a, b = f"{prose(2, 33)} {run} {prose(3, 10)}", f"{prose(4, 5)} {run} {prose(5, 40)}"
    (ha, pa_), (hb, pb) = winnow(pa.array([a, b]))
    places = {h: p for h, p in zip(ha.tolist(), pa_.tolist(), strict=True)}
    assert any(h in places and places[h] - 33 == p - 5 for h, p in zip(hb.tolist(), pb.tolist(), strict=True))


def test_winnow_against_plain_windows():
    text = prose(9, 300, 30)
    every = [winnow(pa.array([" ".join(text.split()[i : i + 5])]))[0][0][0] for i in range(296)]
    kept = {int(p) for p in winnow(pa.array([text]))[0][1]}
    assert all(any(s + d in kept for d in range(16)) for s in range(296 - 15))
    hashes, places = winnow(pa.array([text]))[0]
    assert [int(h) for h in hashes] == [int(every[p]) for p in places]


def test_equal_texts_and_empty_table(spark):
    rows = [(1, prose(1, 90)), (2, prose(1, 90)), (3, edited(prose(1, 90), 1, 0.5))]
    got = {r.doc_id: r.grams for r in fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[2] != got[3]
    assert fingerprints(frame(spark, [])).collect() == with_next(frame(spark, [])).collect() == []


def test_ids_of_any_type_with_an_order(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sluice.llm import fingerprints

    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    rows = [(i, prose(i, 30 + i % 9)) for i in range(60)]
    plain = {r.doc_id: r for r in fingerprints.with_next(frame(spark, rows)).collect()}
    for kind, made in (("string", F.format_string("%03d", F.col("doc_id"))), ("decimal(10,0)", F.col("doc_id").cast("decimal(10,0)")), ("date", F.date_from_unix_date(F.col("doc_id").cast("int")))):
        docs = frame(spark, rows).withColumn("doc_id", made.cast(kind))
        got = sorted(fingerprints.with_next(docs).collect(), key=lambda r: r.doc_id)
        assert [(r.edited_sha256, r.near_next) for r in got] == [(plain[i].edited_sha256, plain[i].near_next) for i in range(60)]
