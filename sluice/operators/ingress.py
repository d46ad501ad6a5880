"""Gates in front of endpoint flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.variants import with_document
from sluice.operators.skew import attach_by_key, within_first
from sluice.operators.tables import spec_table
from sluice.spec import EndpointSource, FlowSpec

ROUTE_SCHEMA = (
    "route string, pipeline_id string, methods array<string>, max_body_bytes int, per_minute int"
)


def normalize_route(path: Column) -> Column:
    """Configured path to its route: `/in/` and its segments in lower case; a leading `in/` is that same one."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    led = F.ltrim(path, F.lit("/")).startswith("in/")
    own = F.when(led, F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1)))).otherwise(segments)
    return F.concat(F.lit("/in/"), F.lower(F.array_join(own, "/")))


def request_route(path: Column) -> Column:
    """Requested path as it is looked up: trailing slashes off, lower case."""
    trimmed = F.lower(F.regexp_replace(path, "/+$", ""))
    return F.when(trimmed == "", F.lower(path)).otherwise(trimmed)


def route_rows(specs: Sequence[FlowSpec]) -> list[tuple]:
    return [
        (s.source.route, s.id, list(s.source.methods), s.source.max_body_bytes, s.source.rate_per_minute)
        for s in specs
        if s.enabled and isinstance(s.source, EndpointSource)
    ]


def rate_gate(
    requests: DataFrame,
    per_minute: Column | int,
    by: str = "pipeline_id",
    ts: str = "received_at",
    request_id: str = "request_id",
    eligible: Column | None = None,
) -> DataFrame:
    """Add `within_rate`: is the request among the first `per_minute` of its flow and minute?

    A NULL limit means no limit; such rows are not counted at all. Bodies stay
    where they are: the last request that passes is found on the key columns,
    for the minutes over their limit only, and then compared with.
    """
    limit = per_minute if isinstance(per_minute, Column) else F.lit(per_minute)
    counted = limit.isNotNull() if eligible is None else eligible & limit.isNotNull()
    minute = F.date_format(F.col(ts), "yyyyMMddHHmm")
    marked = requests.withColumns({"_counted": F.coalesce(counted, F.lit(False)), "_minute": minute})
    keys = (by, "_minute")
    narrow = marked.filter("_counted").select(
        *keys, F.struct(F.col(ts).alias("ts"), F.col(request_id).alias("id")).alias("_at"), limit.alias("_limit")
    )
    ranked = within_first(
        narrow,
        group=[F.col(k) for k in keys],
        order=[F.col("_at")],
        limit=F.col("_limit"),
        salt_by=F.col("_at"),
        name="_passes",
    )
    last = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_passes"), F.col("_at"))).alias("_last"),
        F.count(F.lit(1)).alias("n_items"),
        F.max("_limit").alias("_limit"),
    )
    over = last.filter(F.col("n_items") > F.col("_limit")).drop("_limit")
    compared = attach_by_key(marked, over, keys, (request_id,))
    here = F.struct(F.col(ts).alias("ts"), F.col(request_id).alias("id"))
    passes = F.col("_counted") & (F.col("_last").isNull() | (here <= F.col("_last")))
    return compared.withColumn("within_rate", passes | limit.isNull()).drop("_counted", "_minute", "_last")


def ingress_gate(requests: DataFrame, specs: Sequence[FlowSpec]) -> DataFrame:
    """Add `pipeline_id` and `status`: the refusal code, or NULL for an admitted request.

    Needs `path`, `method`, `authorized`, `body_bytes`, `received_at`, `request_id` and `doc`, or
    `body`, which is then parsed behind the gates: for requests that passed them, and only once.
    The checks run in the order 404, 401, 405, 413, 429, 400, and only requests
    that got past the first four count against the rate.
    """
    routes, small = spec_table(requests.sparkSession, route_rows(specs), ROUTE_SCHEMA)
    looked_up = requests.withColumn("_route", request_route(F.col("path"))).join(
        F.broadcast(routes) if small else routes, F.col("_route") == F.col("route"), "left"
    )
    early = (
        F.when(F.col("route").isNull(), 404)
        .when(~F.coalesce(F.col("authorized"), F.lit(False)), 401)
        .when(~F.array_contains("methods", F.upper("method")), 405)
        .when(F.col("body_bytes") > F.col("max_body_bytes"), 413)
    )
    checked = looked_up.withColumn("_early", early)
    rated = rate_gate(checked, F.col("per_minute"), eligible=F.col("_early").isNull())
    if "doc" not in requests.columns:
        admitted = F.col("_early").isNull() & F.col("within_rate")
        rated = with_document(rated.withColumn("_read", F.when(admitted, F.col("body"))), "_read").drop("_read", "parsed")
    status = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(~F.col("within_rate"), 429)
        .when(F.col("doc").isNull(), 400)
    )
    return rated.withColumn("status", status).drop(
        "_route", "_early", "within_rate", "route", "methods", "max_body_bytes", "per_minute"
    )
