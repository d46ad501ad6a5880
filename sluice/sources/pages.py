"""Landed pages of polled APIs.

Input rows: `cycle_id` (one poll cycle of one flow), `page`, `fetched_at`, `body`,
`http_status`, and `net_code` for a page that got no response. Output rows are
documents, one run per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice import messages as M
from sluice.functions.ids import uuid7_of
from sluice.functions.variants import is_number, path_get, with_document
from sluice.operators.skew import spread_by_key
from sluice.operators.split import with_items
from sluice.sources.spread import spread
from sluice.spec import FlowSpec, PollSource

PAGE_COLUMNS = ("cycle_id", "page", "fetched_at", "body", "http_status", "net_code")
DOCUMENT_COLUMNS = (
    "pipeline_id",
    "ingest_id",
    "run_id",
    "run_created_at",
    "page",
    "origin_kind",
    "http_status",
    "total_record_count",
    "error_code",
    "error_message",
    "doc",
)


def _load(source: DataFrame | str, spark: SparkSession | None, fmt: str) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    return spread((spark or SparkSession.active()).read.format(fmt).load(source))


def page_error(net_code: Column, http_status: Column, doc: Column) -> Column:
    """Why a page cannot be used: the network code, HTTP_<n>, INVALID_JSON, or NULL."""
    bad_status = ~http_status.between(200, 299)
    return (
        F.when(net_code.isNotNull(), net_code)
        .when(bad_status, F.concat(F.lit("HTTP_"), http_status.cast("string")))
        .when(doc.isNull(), F.lit(M.INVALID_JSON))
    )


def _error_message(code: Column, net_code: Column, http_status: Column, page: Column) -> Column:
    def filled(template: str) -> Column:
        text = F.replace(F.lit(template), F.lit("{page}"), page.cast("string"))
        return F.replace(text, F.lit("{status}"), F.coalesce(http_status.cast("string"), F.lit("")))

    return (
        F.when(net_code.isNotNull(), filled(M.NETWORK_FAILURE))
        .when(code == M.INVALID_JSON, filled(M.PAGE_NOT_JSON))
        .when(code.isNotNull(), filled(M.PAGE_STATUS))
    )


def read_pages(
    source: DataFrame | str, spark: SparkSession | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Parse page bodies: adds `parsed` (as sent), `doc` (wrapped), `error_code`; drops `body`."""
    pages = _load(source, spark, fmt)
    for name, kind in (("http_status", "int"), ("net_code", "string")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(200 if name == "http_status" else None).cast(kind))
    pages = pages.withColumn("body_bytes", F.octet_length("body"))
    read = with_document(pages, "body").drop("body")
    code = page_error(F.col("net_code"), F.col("http_status"), F.col("parsed"))
    return read.withColumn("error_code", code)


def cut_failed_pages(pages: DataFrame, cycle: str = "cycle_id") -> DataFrame:
    """Keep each cycle up to and including its first failed page."""
    earlier = Window.partitionBy(cycle).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    failures = F.count(F.col("error_code")).over(earlier)
    return pages.withColumn("_failed", failures).filter(F.col("_failed") == 0).drop("_failed")


def with_page_totals(pages: DataFrame, source: PollSource) -> DataFrame:
    """Add `n_items` and `declared_total`, read from the body as it was sent."""
    counted = with_items(pages, source.items_path)
    count = F.when(F.col("_items").isNull(), F.lit(0)).otherwise(F.size("_items"))
    total = F.lit(None).cast("double")
    if source.total_count_path is not None:
        found = path_get(F.col("parsed"), source.total_count_path)
        total = F.when(is_number(found), F.try_variant_get(found, "$", "double"))
    totals = counted.withColumns({"n_items": count, "declared_total": total})
    return totals.drop("_items", "detail")


def cut_pagination(pages: DataFrame, start: int, max_pages: int, cycle: str = "cycle_id") -> DataFrame:
    """Keep the pages a polling client would have fetched.

    A page is kept unless an earlier one ended the cycle: it had no items, or the
    declared total was reached. The total is the first one declared. The page
    range is cut first, so a window never holds more than `max_pages` rows.
    """
    in_range = pages.filter(F.col("page").between(start, start + max_pages - 1))
    upto = Window.partitionBy(cycle).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(cycle).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    latched = in_range.withColumns(
        {
            "total_record_count": F.first("declared_total", ignorenulls=True).over(upto),
            "_collected": F.sum("n_items").over(upto),
        }
    )
    ends = (F.col("n_items") == 0) | F.coalesce(
        F.col("_collected") >= F.col("total_record_count"), F.lit(False)
    )
    ended = latched.withColumn("_ended", F.coalesce(F.max(ends).over(earlier), F.lit(False)))
    return ended.filter(~F.col("_ended")).drop("_ended", "_collected")


def page_documents(
    source: DataFrame | str,
    spec: FlowSpec,
    spark: SparkSession | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Landed pages to the documents of one flow, failed and surplus pages cut.

    One shuffle, by cycle, of bodies as they came; parsing and both cuts share it.
    Its parts are not joined by size: a few small rows may hold or become large bodies.
    A cycle is at most 1000 pages by its spec.
    """
    if not isinstance(spec.source, PollSource):
        raise ValueError(f"flow '{spec.id}' does not poll")
    paging = spec.source.pagination
    start, max_pages = (paging.start, paging.max_pages) if paging else (1, 1)
    # without pagination the one request carries no page number: the first landed page counts
    landed = spread_by_key(_load(source, spark, fmt), "cycle_id")
    pages = with_page_totals(read_pages(landed), spec.source)
    # a failed page ends the cycle by itself and must not look like an empty one
    pages = cut_failed_pages(pages.filter(F.col("page").between(start, start + max_pages - 1)))
    kept = cut_pagination(pages, start, max_pages)
    page = F.col("page")
    return kept.select(
        F.lit(spec.id).alias("pipeline_id"),
        F.col("cycle_id").cast("string").alias("ingest_id"),
        uuid7_of(F.col("fetched_at"), F.lit(spec.id), F.col("cycle_id").cast("string"), page.cast("string")).alias(
            "run_id"
        ),
        F.col("fetched_at").alias("run_created_at"),
        page.cast("int").alias("page"),
        F.lit("poll").alias("origin_kind"),
        F.when(F.col("net_code").isNull() & (F.col("error_code").isNull()), F.col("http_status"))
        .cast("smallint")
        .alias("http_status"),
        F.when(F.col("error_code").isNull(), F.col("total_record_count")).cast("int").alias("total_record_count"),
        "error_code",
        _error_message(F.col("error_code"), F.col("net_code"), F.col("http_status"), page).alias("error_message"),
        F.when(F.col("error_code").isNull(), F.col("doc")).alias("doc"),
        about(kept, F.lit(spec.source.url)).alias("about"),
    )


# What a run row says of its input besides counts, and the column of the landed rows it comes from.
ABOUT = {
    "request_url": ("url", "string"),
    "content_type": ("content_type", "string"),
    "body_bytes": ("body_bytes", "int"),
    "source_ip": ("source_ip", "string"),
    "trace_id": ("trace_id", "string"),
    "elapsed_ms": ("elapsed_ms", "int"),
}


def about(rows: DataFrame, url: Column | None = None) -> Column:
    """The facts of `ABOUT` as one struct; columns the rows lack are NULL, a missing URL is `url`."""
    facts = []
    for name, (column, kind) in ABOUT.items():
        value = F.col(column) if column in rows.columns else F.lit(None)
        if name == "request_url" and url is not None:
            value = F.coalesce(value.cast(kind), url)
        facts.append(value.cast(kind).alias(name))
    return F.struct(*facts)
