"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of columns (say domain, language, source). At each node the children get shares by their
weights; a child that cannot use its share, even with `max_epochs` passes over its data, gets what it can use, and the
rest is shared among its siblings. Only what all siblings together cannot use is left to the node's own siblings, since a
node's capacity is the sum of its children's, those of weight 0 left out. Shares are whole tokens, rounded down.

Each leaf is read in epochs. Full epochs take all of it; the last one takes the documents in the order of a hash seeded
with the epoch, as long as their tokens fit. The order is by the hash, so a prefix is found without sorting a leaf:
tokens are summed by leaf and hash bucket, and only the bucket in which the budget ends is ordered row by row.

Defined cases: a null level counts as the empty name; a null or empty text has no tokens and comes with each full epoch
and with the prefix up to its place; rows of equal id, text and levels are taken or left together; weights that are not
named are 1, negative ones are an error; a table without tokens gives full epochs of nothing (no rows); other columns
are ignored by `plan_mix` and kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
HASH_DIGITS = 3


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Weight of the node named by `levels`; a name of the last level only applies below every parent."""
    found = F.lit(1).cast("bigint")
    for path, weight in sorted(weights.items(), key=lambda x: len(x[0])):
        if weight < 0:
            raise ValueError(f"weight of {path} is negative")
        if len(path) == len(levels):
            same = F.lit(True)
            for level, name in zip(levels, path, strict=True):
                same = same & ((F.col(level) == name) | F.lit(name == "*"))
            found = F.when(same, F.lit(weight).cast("bigint")).otherwise(found)
    return found


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: int, max_epochs: int
) -> DataFrame:
    """Leaves (levels, tokens) with `budget`, `epochs` (full ones) and `rest` (tokens of the last, partial one).

    One window per level over the children of a node, in the order in which growing shares fill them.
    """
    wide = "decimal(38,0)"
    capacity = {len(levels): leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast(wide))}
    for depth in range(len(levels) - 1, 0, -1):
        used = F.when(_weight(levels[: depth + 1], weights) > 0, F.col("capacity")).otherwise(0)
        capacity[depth] = capacity[depth + 1].groupBy(*levels[:depth]).agg(F.sum(used).cast(wide).alias("capacity"))
    above = None
    for depth in range(1, len(levels) + 1):
        names = list(levels[:depth])
        nodes = capacity[depth].withColumn("weight", _weight(names, weights).cast("decimal(18,0)"))
        nodes = nodes.withColumn("given", F.lit(budget).cast(wide)) if above is None else nodes.join(above, names[:-1])
        siblings = Window.partitionBy(*names[:-1]) if depth > 1 else Window.partitionBy(F.lit(0))
        # Unweighted nodes get nothing: they come last and have no part in the sums.
        ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double"))
        filling = siblings.orderBy(ratio.asc_nulls_last(), F.col(names[-1])).rowsBetween(Window.unboundedPreceding, -1)
        used = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)
        nodes = nodes.withColumns(
            {
                "left": (F.col("given") - F.coalesce(F.sum(used).over(filling), F.lit(0))).cast("decimal(28,0)"),
                "open": (F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(filling), F.lit(0))).cast("decimal(18,0)"),
            }
        )
        full = (F.col("weight") > 0) & (F.col("capacity") * F.col("open") <= F.col("left") * F.col("weight"))
        nodes = nodes.withColumn("full", full)
        first_open = siblings.orderBy(ratio.asc_nulls_last(), F.col(names[-1])).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        level = {
            c: F.first(F.when(~F.col("full") & (F.col("weight") > 0), F.col(c)), ignorenulls=True).over(first_open)
            for c in ("left", "open")
        }
        share = F.expr("(level_left * weight) div level_open").cast(wide)
        nodes = nodes.withColumns({f"level_{c}": v for c, v in level.items()})
        nodes = nodes.withColumn(
            "given", F.when(F.col("weight") == 0, 0).when(F.col("full"), F.col("capacity")).otherwise(share).cast(wide)
        )
        above = nodes.select(*names, "given")
    spent = F.col("given").cast("bigint")
    return (
        leaves.join(above, list(levels))
        .withColumn("budget", spent)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        .drop("given")
    )


def plan_mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple[str, ...], int],
    budget_share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per distinct row (id, `row` = xxhash64 of its text, levels, tokens): `copies`, how often the mix takes it.

    The budget is `budget_share` of all tokens (words). Rows with 0 copies are included.
    """
    names = list(levels)
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("row"),
            *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()),
            tokens.alias("tokens"),
        )
        .groupBy("id", "row", *names)
        .agg(F.sum("tokens").alias("tokens")),
        "rows",
    )
    leaves = written(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = written(
        budgets(leaves, names, weights, int(total * budget_share), max_epochs).withColumnRenamed("tokens", "leaf_tokens"),
        "shares",
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("row").cast("string")))
    placed = rows.join(shares, names).withColumn("order", order).withColumn("bucket", F.substring("order", 1, HASH_DIGITS))
    sums = written(
        placed.groupBy(*names, "bucket").agg(F.sum("tokens").alias("in_bucket")),
        "buckets",
    )
    so_far = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = written(sums.withColumn("end", F.sum("in_bucket").over(so_far)).withColumn("begin", F.col("end") - F.col("in_bucket")), "ends")
    known = placed.join(ends, [*names, "bucket"])
    inside = known.where("end <= rest").withColumn("copies", F.col("epochs") + 1)
    outside = known.where("begin >= rest and end > rest").withColumn("copies", F.col("epochs"))
    within = Window.partitionBy(*names, "bucket").orderBy("order", "id", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        known.where("begin < rest and end > rest")
        .withColumn("upto", F.sum("tokens").over(within))
        .withColumn("copies", F.col("epochs") + (F.col("begin") + F.col("upto") <= F.col("rest")).cast("bigint"))
        .drop("upto")
    )
    return inside.unionByName(outside).unionByName(edge).select("id", "row", *names, "tokens", F.col("copies").cast("bigint"))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple[str, ...], int],
    id_col: str = "doc_id",
    text_col: str = "text",
    **options: float,
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as `plan_mix` takes it."""
    plan = plan_mix(docs, levels, weights, id_col=id_col, text_col=text_col, **options).where("copies > 0")
    taken = plan.select(
        F.col("id").alias("_mix_id"),
        F.col("row").alias("_mix_row"),
        F.col("copies").alias("_mix_copies"),
        *(F.col(n).alias(f"_mix_{n}") for n in levels),
    )
    same = docs[id_col].eqNullSafe(F.col("_mix_id")) & (F.xxhash64(docs[text_col]) == F.col("_mix_row"))
    for name, column in levels.items():
        same = same & (F.coalesce(column.cast("string"), F.lit("")) == F.col(f"_mix_{name}"))
    copy = F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("_mix_copy")
    return docs.join(taken, same).select(*(docs[c] for c in docs.columns), copy).drop("_mix_copy")
