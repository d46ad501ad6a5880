"""The numbered queries over whole tables, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import fingerprints, licenses, mixture, negatives, oracles, pieces, prefixes, quality, secrets, suffixes, urls
from sluice.llm.jaccard import near_duplicates
from sluice.llm.neighbours import nearest
from sluice.llm.substrings import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and paragraphs of every text that are near a license template."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op1_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of words of every text that are near a license template, over and inside lines and paragraphs."""
    return licenses.passages(table(spark, sf_dir, "documents"))


@query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every text, its edited text and the likeness to that and to the next document."""
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


@query
def op3_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product of each vector whose id is divisible by 20, against all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four best segmentations of every text, and whether decoding the best gives the text back."""
    return pieces.encode(table(spark, sf_dir, "documents"), n_best=4)


URL_RULES = (
    urls.Rule("com", "/", True),
    urls.Rule("example.com", "/en/", False),
    urls.Rule("www.example.com", "/en/", True),
    urls.Rule("net", "/es/", False),
    urls.Rule("net", "/fr/", False),
)


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, the ratio of two character models for the rest."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, Jaccard 0.85: each document's set size and group."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85).drop("row", "group")


def mix_levels() -> dict[str, Column]:
    """Domain by source, then language, then source."""
    source = F.col("source")
    domain = F.when(source == "src0", "crawl").when(source.rlike("^src[1-9]$"), "forum").when(source.isNotNull(), "press")
    return {"domain": domain, "lang": F.col("lang"), "source": source}


MIX_WEIGHTS = {
    ("crawl",): 30,
    ("forum",): 30,
    ("press",): 40,
    ("*", "en"): 50,
    ("*", "de"): 20,
    ("*", "fr"): 20,
    ("*", "es"): 10,
}


@query
def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget of all tokens over domain, language and source by weight, at most three epochs of a leaf."""
    planned = mixture.plan_mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, 1.0, 3)
    return planned.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "tokens", "copies")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and linked weak parts of every text."""
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained chance of good quality of every document."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_content", "p_metadata", "p_quality", "keep")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document of smaller id also has are removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), min_words=50).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hardest negatives for each of the five best positives of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=5)
    return mined.select(
        *(F.col(c).cast("bigint").alias(c) for c in ("anchor_id", "positive_id")),
        "rank",
        *(F.col(c).cast("bigint").alias(c) for c in ("negative_id", "positive_score", "negative_score")),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first turns of the one its id rounds down to."""
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefixes.shared_heads(table(spark, sf_dir, "conversations"), conv - conv % 5, head)


@query
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that start anywhere else are removed."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), min_bytes=200).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLES |= {
    "op11_hard_negatives": oracles.negatives(),
    "op12_prefix_trie": oracles.prefixes(),
    "op1_license_scan": oracles.licenses(),
    "op6_ngram_jaccard_join": oracles.jaccard(),
    "op8_secret_scan": oracles.secrets(),
    "op10_substring_dedup": oracles.substrings(),
}
