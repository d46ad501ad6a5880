"""Shapes that keep one heavy key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are
# never HOT_SHARE hot keys: the broadcast below is bounded whatever the data.
HOT_SHARE = 10_000
SALTS = 64
# Partitions per core where rows carry bodies.
PARTS_PER_CORE = 8


def spread_by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with bodies dealt by key to many partitions, which are not joined again afterwards.

    Spark joins partitions by their compressed size, and bodies that repeat themselves shrink a hundredfold: a task
    that sorts them would hold as many cores' shares of all bodies. Grouping and joining by the same keys go on from here.
    """
    spark = rows.sparkSession
    wanted = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    return rows.repartition(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def attach_by_key(
    rows: DataFrame,
    info: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    weight: str = "n_items",
) -> DataFrame:
    """Left join `info` (one row per key, with its row count in `weight`) onto `rows`.

    Hot keys meet a broadcast of fewer than HOT_SHARE rows. Their rows then go
    through the shuffle join under a key of their own made from `spread_by`,
    which matches nothing and spreads them evenly. `rows` is read once.
    """
    values = [c for c in info.columns if c not in keys and c != weight]
    total = info.agg(F.sum(weight)).scalar()
    packed = info.select(*keys, F.struct(*values).alias("_info"), weight)
    hot = packed.filter(F.col(weight) * HOT_SHARE > total).select(
        *keys, F.col("_info").alias("_hot")
    )
    marked = rows.join(F.broadcast(hot), list(keys), "left")
    *lead, last = keys
    lone = F.concat(F.lit("#"), F.concat_ws("|", *[F.col(c).cast("string") for c in spread_by]))
    marked = marked.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(last)).otherwise(lone))
    looked_up = packed.drop(weight).withColumnRenamed(last, "_key")
    joined = marked.join(looked_up, [*lead, "_key"], "left")
    found = F.coalesce("_hot", "_info")
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def within_first(
    rows: DataFrame,
    group: Sequence[Column],
    order: Sequence[Column],
    limit: Column | int,
    salt_by: Column,
    eligible: Column | None = None,
    name: str = "within_first",
) -> DataFrame:
    """Add a boolean column: is the row among the first `limit` eligible rows of its group?

    Two rounds of the same question. Each group is first split into SALTS parts,
    and a row outside the first `limit` of its part cannot be within the first
    `limit` of the group. The second round only gathers what is left, at most
    SALTS * limit rows of a group; everything else stays spread.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    eligible = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    # the group's own columns, not copies under other names: a filter on them later on is then taken to the rows
    marked = rows.withColumns(
        {
            "_ok": eligible,
            "_salt": F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"),
        }
    )
    part = Window.partitionBy(*group, "_ok", "_salt").orderBy(*order)
    marked = marked.withColumn("_part", F.row_number().over(part))
    contender = F.col("_ok") & (F.col("_part") <= limit)
    marked = marked.withColumn("_round", F.when(contender, F.lit(-1)).otherwise(F.col("_salt")))
    final = Window.partitionBy(*group, "_round").orderBy(*order)
    marked = marked.withColumn("_rank", F.row_number().over(final))
    verdict = (F.col("_round") == -1) & (F.col("_rank") <= limit)
    return marked.withColumn(name, verdict).drop("_ok", "_salt", "_part", "_round", "_rank")
