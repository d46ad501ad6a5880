"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

1. quality: documents the co-trained classifier rejects go.
2. near_duplicates: of each group linked by five-word shingles (Jaccard 0.8 or more) the one of least id stays.
3. secrets: reported spans are masked in the texts.
4. mixture: documents are taken so often as the weights of domain, language and source ask for.
5. pieces: texts become token ids, with the next best segmentations.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import jaccard, mixture, pieces, quality, secrets
from sluice.llm.queries import MIX_WEIGHTS, mix_levels
from sluice.llm.scratch import written

MAX_EPOCHS = 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_group(docs, n=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs, mix_levels(), MIX_WEIGHTS, budget_share=1.0, max_epochs=MAX_EPOCHS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("pieces", token_ids),
]

# Classifier and segmentation are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
