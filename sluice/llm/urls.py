"""URL filter by the ratio of two character language models.

Listed hosts and paths decide the URLs they fit. Their URLs train two smoothed variable-order Markov models over
characters, one for accepted and one for rejected: the chance of a character after its last `order` characters backs off
through shorter contexts by Witten-Bell weights. A URL no rule fits is judged by the difference of its log-likelihoods
per character against a threshold calibrated on URLs with a rule that were held out of the counts.

All URLs with a rule are counted (but for the held-out share, picked by hash), so what the models know grows with the
input; nothing of them is gathered in the driver but the histogram used for the threshold, of CALIBRATION_BINS bins.
Contexts are joined by shuffle joins on written tables, which the optimizer splits where a context is hot.

Defined cases: a null URL or one without `://` has empty host and path and is scored over nothing (difference 0); with
no rule-decided URLs of one of the classes all others are allowed; equal URLs get equal verdicts; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.scratch import written

ORDER = 4
HELD_OUT = 5
CALIBRATION_BINS = 400
BIN_WIDTH = 0.02
START = "\x02"
END = "\x03"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, a start of the path, and what that means."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From behind the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name of the longest rule that fits, and whether it allows; null without one. `rules` is a short list."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, allow = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.allow).otherwise(allow)
    return name, allow


def _grams(text: Column, order: int) -> Column:
    """For each character, and the end, it and the `order` characters before it."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - order), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_odds(trained: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """`gram`, `odds`: log of the accepted over the rejected chance of each wanted gram's last character.

    `trained` has gram, allow, n; `wanted` has distinct grams.
    """
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: F.substring("gram", order + 1 - k, k + 1)))
    by_class = lambda allow: F.sum(F.when(F.col("allow") == allow, F.col("n")).otherwise(0))
    counts = written(
        trained.select(every.alias("tail"), "allow", "n")
        .groupBy("tail")
        .agg(by_class(True).alias("n_1"), by_class(False).alias("n_0")),
        "tails",
    )
    # Per context: how often it was seen and how many different characters followed.
    contexts = written(
        counts.groupBy(F.expr("substring(tail, 1, length(tail) - 1)").alias("context")).agg(
            *(F.sum(f"n_{c}").alias(f"all_{c}") for c in (0, 1)),
            *(F.sum((F.col(f"n_{c}") > 0).cast("bigint")).alias(f"kinds_{c}") for c in (0, 1)),
        ),
        "contexts",
    )
    tails = wanted.select("gram", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: F.substring("gram", order + 1 - k, k + 1))).alias("k", "tail"))
    known = (
        tails.withColumn("context", F.expr("substring(tail, 1, length(tail) - 1)"))
        .join(counts, "tail", "left")
        .join(contexts, "context", "left")
        .na.fill(0)
    )
    steps = known.groupBy("gram").agg(
        F.array_sort(F.collect_list(F.struct("k", "n_0", "n_1", "all_0", "all_1", "kinds_0", "kinds_1"))).alias("steps")
    )

    def chance(c: int) -> Column:
        """Witten-Bell: the shorter context's chance weighs as much as there were kinds of characters."""
        seen = lambda s: s[f"all_{c}"] + s[f"kinds_{c}"]
        return F.aggregate(
            "steps",
            F.lit(1.0 / 256),
            lambda p, s: F.when(seen(s) == 0, p).otherwise((s[f"n_{c}"] + s[f"kinds_{c}"] * p) / seen(s)),
        )

    return steps.select("gram", (F.log(chance(1)) - F.log(chance(0))).alias("odds"))


def threshold_of(held: DataFrame) -> float:
    """Difference that separates held-out accepted from rejected URLs with the least balanced error.

    `held` has score and allow. Works on a histogram of fixed size; ties go to the threshold nearest to 0.
    """
    half = CALIBRATION_BINS // 2
    bin_of = F.greatest(F.lit(-half), F.least(F.lit(half), F.floor(F.col("score") / BIN_WIDTH).cast("int")))
    counts = {(r.bin, r.allow): r["count"] for r in held.groupBy(bin_of.alias("bin"), "allow").count().collect()}
    accepted = sum(n for (_, allow), n in counts.items() if allow)
    rejected = sum(counts.values()) - accepted
    if not accepted or not rejected:
        return 0.0
    lost, passed = 0, rejected
    best, at = 2.0, 0.0
    for b in range(-half, half + 2):
        error = lost / accepted + passed / rejected
        if (error, abs(b)) < (best, abs(at)):
            best, at = error, b
        lost += counts.get((b, True), 0)
        passed -= counts.get((b, False), 0)
    return at * BIN_WIDTH


def judge(
    pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url", order: int = ORDER
) -> DataFrame:
    """Every row's host, path, rule, verdict (allow or block), score (log odds per character) and threshold."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, allow = matched(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule, "allow": allow})
    body = F.when(F.locate("://", F.col("url")) > 0, F.concat("host", F.expr("substring(url, instr(url, '://') + 3 + length(host))"))).otherwise("")
    urls = written(
        rows.groupBy("url", "host", "path", "rule", "allow").count().withColumn("body", body)
        .withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0),
        "urls",
    )
    pieces = urls.where("body <> ''").select("url", "allow", "held", "count", F.explode(_grams(F.col("body"), order)).alias("gram"))
    counted = written(
        pieces.groupBy("gram", "allow", "held").agg(F.sum("count").alias("n")), "grams"
    )
    trained = counted.where("allow is not null and not held").select("gram", "allow", "n")
    odds = written(gram_odds(trained, counted.select("gram").distinct(), order), "odds")
    scores = written(
        pieces.select("url", "gram").join(odds, "gram").groupBy("url").agg(F.avg("odds").alias("score")), "scores"
    )
    judged = urls.join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    present = {r.allow for r in trained.select("allow").distinct().collect()}
    threshold = threshold_of(judged.where("held and allow is not null").select("score", "allow")) if len(present) == 2 else None
    verdict = F.coalesce("allow", F.lit(True) if threshold is None else F.col("score") >= F.lit(threshold))
    result = judged.select(
        F.col("url").alias("url_"), "score", F.when(verdict, "allow").otherwise("block").alias("verdict")
    )
    return rows.join(result, F.col("url").eqNullSafe(F.col("url_")), "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score", F.lit(threshold).cast("double").alias("threshold")
    )
