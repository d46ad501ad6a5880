"""Secret scans with multipart credential linking, in DataFrame functions only.

Three kinds are reported wherever they stand: assign (a secret word with a value), access (access key ids) and hex (long
hexadecimal runs). Three weak kinds are not proof of anything alone: ident (account and client ids), blob (long mixed
tokens) and endpoint (addresses with a scheme or port). Each part has a role: access and ident name an identity, assign,
hex and blob a secret, endpoint a place. A weak part is reported when a part of another role that completes it lies within
`reach` code points in the same text: an ident needs a secret, a blob an identity or a place, an endpoint a secret.

Parts are found with one split and one extraction by kind, only in texts that can match. Linking is an interval join made
as one sweep over the parts of each text in both directions; texts themselves are not shuffled for it.

Positions are code points, end exclusive. Defined cases: null and empty texts have no spans; rows of equal id are told
apart by their text; equal rows give equal rows; other columns are ignored by `find_secrets` and kept by `mask_secrets`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.scratch import written

REACH = 400
BLOCK = 64
MASK = "<secret>"


@dataclass(frozen=True)
class Kind:
    """What is looked for: `pattern`, or in its place `long` where matches are maximal runs of some length. `probe` is a cheap sign that a text may hold a match; `keep` is what a match must satisfy."""

    name: str
    role: str
    pattern: str
    probe: str
    keep: tuple[str, ...]
    weak: bool = False
    long: str | None = None

    @property
    def scanned(self) -> str:
        """What is searched for: `long` finds the matches of `pattern` that are long enough. Both match whole runs."""
        return self.long or self.pattern


# Fixed patterns of the three base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

KINDS = (
    Kind("assign", "secret", ASSIGN, ASSIGN[:-2] + "{6})", ("[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}$",)),
    Kind("access", "identity", ACCESS, r"AKIA[A-Z0-9]{16}", (r"^.{20}",), long=r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", "secret", HEX, r"[0-9a-f]{24}", (r"^.{24}",), long=r"[0-9a-f]{24,}"),
    Kind(
        "ident",
        "identity",
        r"""((?i:client|account|access|tenant|user)[_-](?i:id|key|name))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""",
        r"(?i:client|account|access|tenant|user)[_-](?i:id|key|name)",
        ("[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,}$",),
        True,
    ),
    Kind("blob", "secret", r"[A-Za-z0-9+/_-]+", r"[A-Za-z0-9+/_-]{24}", (r"^.{24}", "[a-z]", "[A-Z]", "[0-9]"), True, r"[A-Za-z0-9+/_-]{24,}"),
    Kind(
        "endpoint",
        "place",
        r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]+",
        r"://|[A-Za-z0-9]:[0-9]",
        (r"^.{4}",),
        True,
    ),
)
RANK = {k.name: i for i, k in enumerate(KINDS)}
SPAN = "array<struct<start: int, rank: int, end: int>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """Spans of one kind: leftmost matches that do not overlap, those that fail `keep` left out afterwards."""
    around = F.transform(F.split(text, kind.scanned, -1), lambda x: F.length(x))
    found = F.arrays_zip(around.alias("gap"), F.regexp_extract_all(text, F.lit(kind.scanned), F.lit(0)).alias("hit"))
    pairs = F.filter(found, lambda p: p["hit"].isNotNull())

    def passes(hit: Column) -> Column:
        good = F.lit(True)
        for condition in kind.keep:
            good = good & hit.rlike(condition)
        return good

    # Matches are placed by running sums, first of blocks and then inside each: arrays that grow by one element per match
    # are as long as a block at most, so the work stays near the length of the text.
    count = F.greatest(F.ceil(F.size(pairs) / BLOCK).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))

    def width(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["hit"]))

    starts = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda state, block: F.struct((state["at"] + width(block)).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out")),
    )["out"]

    def placed(block: Column) -> Column:
        def step(state: Column, p: Column) -> Column:
            start = state["at"] + p["gap"]
            end = start + F.length(p["hit"])
            span = F.struct(start.alias("start"), F.lit(RANK[kind.name]).alias("rank"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(passes(p["hit"]), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        first = F.struct(block["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(block["block"], first, step)["out"]

    shaped = F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("at")), placed))
    return F.when(text.rlike(kind.probe), shaped).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    """`kind:start:end` by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def linked(parts: DataFrame, reach: int = REACH, beyond: bool = False) -> DataFrame:
    """Weak parts (id, row, start, rank, end) with a completing part in reach, but for those that overlap a base span; with
    `beyond` only those that one base span covers whole are left out.

    The sweep keeps, per role, the furthest end before and the nearest start behind each part of the same text.
    """
    roles = F.array(*(F.lit(k.role) for k in KINDS))
    weak_from = min(RANK[k.name] for k in KINDS if k.weak)
    rows = parts.withColumn("role", F.get(roles, F.col("rank")))
    before = Window.partitionBy("id", "row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("id", "row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for role in ("identity", "secret", "place"):
        rows = rows.withColumn(f"end_{role}", F.max(F.when(F.col("role") == role, F.col("end"))).over(before))
        near[role] = (F.col("start") - F.col(f"end_{role}") <= reach) | (F.col(f"start_{role}") - F.col("end") <= reach)
    strong = F.col("rank") < weak_from
    rows = rows.withColumn("end_strong", F.max(F.when(strong, F.col("end"))).over(before))
    for role in ("identity", "secret", "place"):
        rows = rows.withColumn(f"start_{role}", F.min(F.when(F.col("role") == role, F.col("start"))).over(behind))
    rows = rows.withColumn("start_strong", F.min(F.when(strong, F.col("start"))).over(behind))
    inside = F.coalesce(F.col("end_strong") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("start_strong") < F.col("end"), F.lit(False)
    )
    if beyond:
        # Of equal starts base spans come first, so a span that covers a part is before it.
        inside = F.coalesce(F.col("end_strong") >= F.col("end"), F.lit(False))
    name = {k.name: F.col("rank") == RANK[k.name] for k in KINDS}
    sure = {role: F.coalesce(test, F.lit(False)) for role, test in near.items()}
    completes = (
        (name["ident"] & sure["secret"])
        | (name["blob"] & (sure["identity"] | sure["place"]))
        | (name["endpoint"] & sure["secret"])
    )
    return rows.where(~strong & ~inside & completes).select("id", "row", "start", "rank", "end")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, beyond: bool = False
) -> DataFrame:
    """Every document with its spans: the id, `row` (xxhash64 of the text), `base` and `spans`, arrays of
    struct(start, rank, end) where rank counts in KINDS; `spans` holds base spans and linked weak parts (see `linked`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [k for k in KINDS if not k.weak]
    weak = [k for k in KINDS if k.weak]
    found = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text).alias("row"),
            F.array_sort(F.concat(*(spans_of(text, k) for k in base))).alias("base"),
            F.array_sort(F.concat(*(spans_of(text, k) for k in weak))).alias("weak"),
        ),
        "spans",
    )
    parts = (
        found.where(F.size("weak") > 0)
        .select("id", "row", "base", "weak")
        .dropDuplicates(["id", "row"])
        .select("id", "row", F.inline(F.concat("base", "weak")))
    )
    more = (
        linked(parts, reach, beyond)
        .groupBy("id", "row")
        .agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
        .select(F.col("id").alias("id_more"), F.col("row").alias("row_more"), "more")
    )
    same = F.col("id").eqNullSafe(F.col("id_more")) & (F.col("row") == F.col("row_more"))
    joined = found.join(more, same, "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return joined.select(F.col("id").alias(id_col), "row", "base", spans.alias("spans"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, a digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == RANK[kind])).cast("bigint")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The documents with every base span and linked part, also one that reaches beyond a base span, replaced by MASK (one
    for spans that overlap); texts without spans and other columns stay."""
    found = (
        find_secrets(docs, id_col, text_col, reach, beyond=True)
        .where(F.size("spans") > 0)
        .select(F.col(id_col).alias("_mask_id"), F.col("row").alias("_mask_row"), F.col("spans").alias("_mask_spans"))
        .dropDuplicates(["_mask_id", "_mask_row"])
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col("_mask_id")) & (F.xxhash64(text) == F.col("_mask_row"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        "_mask_spans",
        start,
        lambda state, s: F.when(
            s["start"] >= state["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(MASK)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))),
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    return docs.join(found, same, "left").select(
        *(
            F.when(F.col("_mask_spans").isNotNull(), masked).otherwise(docs[c]).alias(c) if c == text_col else docs[c]
            for c in docs.columns
        )
    )
