"""Request bodies that were POSTed to an endpoint.

Input rows: `request_id`, `received_at`, `body`, `headers` (map<string,string>),
optionally `source_ip`. Every request is one document and one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.ids import uuid7_of
from sluice.functions.redact import lower_keys
from sluice.functions.variants import with_document
from sluice.sources.pages import _load, about


def read_requests(
    source: DataFrame | str, spark: SparkSession | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Adds `doc`, `body_bytes`, `body_sha256`, `content_type`, `page` (always 1).

    Streams pass through unchanged: only row-wise expressions are used.
    """
    requests = _load(source, spark, fmt)
    if "source_ip" not in requests.columns:
        requests = requests.withColumn("source_ip", F.lit(None).cast("string"))
    return with_document(requests, "body").drop("parsed").select(
        "*",
        F.octet_length("body").alias("body_bytes"),
        F.sha2("body", 256).alias("body_sha256"),
        lower_keys(F.col("headers"))["content-type"].alias("content_type"),
        F.lit(1).alias("page"),
    )


def split_invalid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a document, requests whose body is not JSON with the 400 error)."""
    broken = requests.filter(F.col("doc").isNull()).withColumns(
        {"status": F.lit(400), "error": F.lit(M.INVALID_BODY)}
    )
    return requests.filter(F.col("doc").isNotNull()), broken


def request_documents(requests: DataFrame, pipeline_id: str | None = None) -> DataFrame:
    """Admitted requests to documents; a `pipeline_id` column serves when none is named."""
    flow = F.col("pipeline_id") if pipeline_id is None else F.lit(pipeline_id)
    request = F.col("request_id").cast("string")
    return requests.filter(F.col("doc").isNotNull()).select(
        flow.alias("pipeline_id"),
        request.alias("ingest_id"),
        uuid7_of(F.col("received_at"), flow, request).alias("run_id"),
        F.col("received_at").alias("run_created_at"),
        "page",
        F.lit("endpoint").alias("origin_kind"),
        F.lit(None).cast("smallint").alias("http_status"),
        F.lit(None).cast("int").alias("total_record_count"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
        lower_keys(F.col("headers")).alias("headers"),
        "doc",
        about(requests).alias("about"),
    )
