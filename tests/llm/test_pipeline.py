from __future__ import annotations

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from sluice.llm.pieces import Pieces, default_model
from sluice.llm.secrets import find_secrets, report

from helpers import awkward, edited, prose
from test_jaccard import brute as groups_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rows = [(i, prose(i, 30 + i % 50, 3_000)) for i in range(120)]
    rows += [(200 + i, prose(i, 30 + i % 50, 3_000)) for i in range(10)]
    rows += [(220 + i, edited(prose(20 + i, 30 + (20 + i) % 50, 3_000), i, 0.01)) for i in range(10)]
    rows += [(300 + i, " ".join(w + "%%%" for w in prose(900 + i, 60).split())) for i in range(40)]
    rows += [(400, prose(950, 40) + " password=abcdef123 " + prose(951, 40))]
    return rows + awkward()


def test_stages_on_planted_cases(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 13}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(i < 300)) for i, _ in rows if i is not None and i < 400 and i % 5 and i not in range(0, 30)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pieces":
            assert before.columns == COLUMNS
    good = {(r.doc_id, r.text) for r in kept["quality"].collect()}
    assert not [i for i, _ in good if i is not None and 300 <= i < 340]
    assert {i for i, t in rows if i is not None and i < 300} <= {i for i, _ in good}

    after = [(r.doc_id, r.text) for r in kept["near_duplicates"].collect()]
    groups = groups_of(sorted(good, key=repr), 5, 80)
    # 906 names two texts, which are two groups; the null id is a group of its own.
    assert len(after) == len({c for i, _, c in groups if i is not None}) + 2
    assert not {200 + i for i in range(10)} & {i for i, _ in after}

    masked = kept["secrets"]
    assert report(find_secrets(masked)).where("n_assign + n_access + n_hex > 0").count() == 0
    assert "password=<" not in masked.where("doc_id = 400").first().text
    assert masked.count() == len(after)
    assert masked.where("text is not null and n_chars <> length(text)").count() == 0

    coded = kept["pieces"].collect()
    assert len(coded) == kept["mixture"].count()
    with open(default_model(), "rb") as file:
        plain = Pieces(file.read())
    texts = {r.doc_id: r.text or "" for r in kept["mixture"].where("doc_id < 100").collect()}
    for r in coded:
        if r.doc_id in texts:
            assert r.round_trip and r.ids == plain.encode(texts[r.doc_id], 1)[0].tolist()

    whole = pipeline.run(spark, str(tmp_path)).select("doc_id", F.hash("ids").alias("h"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, kept["pieces"].select("doc_id", F.hash("ids").alias("h")).collect()))


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
