"""Documents to items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice import messages as M
from sluice.functions.variants import as_array, bind, is_absent, is_object, path_get


def with_items(docs: DataFrame, items_path: str | None, doc: str = "doc") -> DataFrame:
    """Add `_items`, array<variant> of the objects found, and `detail`, why there are none."""
    found = F.col(doc) if items_path is None else path_get(F.col(doc), items_path)
    read = bind(docs, {"_found": found})
    read = bind(read, {"_members": as_array(F.col("_found")), "_single": is_object(F.col("_found"))})
    items = F.when(
        F.col("_members").isNotNull(), F.filter(F.col("_members"), is_object)
    ).when(F.col("_single"), F.array("_found"))
    neither = F.col("_members").isNull() & ~F.col("_single")
    if items_path is None:
        detail = F.when(neither, M.BODY_NOT_ITEMS)
    else:
        detail = F.when(
            is_absent(F.col("_found")), M.ITEMS_PATH_ABSENT.format(path=items_path)
        ).when(neither, M.ITEMS_PATH_NOT_ITEMS.format(path=items_path))
    return read.withColumns({"_items": items, "detail": detail}).drop("_found", "_members", "_single")


def split_entries(docs: DataFrame, items_path: str | None, doc: str = "doc") -> DataFrame:
    """One row per item, plus one marker row for a document without items.

    Adds `idx`, `item`, `entry` (item | empty | rejected), `reason`, `detail`. The index
    is dense per document after members that are not objects were dropped. When
    several documents share a run (column `doc_idx`), it runs on through them.
    """
    staged = with_items(docs, items_path, doc).drop(doc)
    base = F.lit(0)
    if "doc_idx" in docs.columns:
        # Documents, not items, are ordered here: as many rows as one request has bodies.
        earlier = Window.partitionBy("run_id").orderBy("doc_idx").rowsBetween(
            Window.unboundedPreceding, -1
        )
        count = F.coalesce(F.size("_items"), F.lit(0))
        staged = staged.withColumn("_base", F.coalesce(F.sum(F.greatest(count, F.lit(0))).over(earlier), F.lit(0)))
        base = F.col("_base")
    kept = [c for c in staged.columns if c not in ("_items", "_base", "detail")]
    exploded = staged.select(
        *kept, base.alias("_from"), "detail", F.posexplode_outer("_items").alias("_pos", "item")
    )
    rejected = F.col("detail").isNotNull()
    return exploded.select(
        *kept,
        F.when(F.col("_pos").isNotNull(), (F.col("_pos") + F.col("_from")).cast("int"))
        .when(rejected, F.lit(0))
        .alias("idx"),
        "item",
        F.when(rejected, "rejected").when(F.col("_pos").isNull(), "empty").otherwise("item").alias("entry"),
        F.when(rejected, M.ITEMS_PATH_NOT_FOUND).alias("reason"),
        "detail",
    )


def split_items(
    docs: DataFrame, items_path: str | None, doc: str = "doc"
) -> tuple[DataFrame, DataFrame]:
    """(items, rejected documents)."""
    entries = split_entries(docs, items_path, doc)
    items = entries.filter(F.col("entry") == "item").drop("entry", "reason", "detail")
    rejected = entries.filter(F.col("entry") == "rejected").drop("entry", "item")
    return items, rejected
