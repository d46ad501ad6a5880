"""Queries over outcomes, run rows, counters, retention and redaction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.dates import month_partition
from sluice.functions.redact import mask_body, mask_headers, mask_url, scrub
from sluice.operators import audit, retention
from sluice.operators.redaction import mask_error
from sluice.plans import frames
from sluice.plans.intake import plan_intake
from sluice.plans.queries_intake import KEYED_SQL, PAGES_SQL, gated_requests, intake, sql_uuid7
from sluice.plans.queries_intake import ledger as stored_keys
from sluice.plans.registry import query
from sluice.sources.requests import request_documents

# --- poll runs -------------------------------------------------------------

# every kept item with its outcome
_OUTCOMES_SQL = (
    "WITH "
    + KEYED_SQL
    + """,
outc AS (
  SELECT it.cycle, it.page, it.idx, it.n, it.event_type,
         CASE WHEN NOT it.keep THEN 'filtered' WHEN res.accepted THEN 'accepted' ELSE 'duplicate' END AS status,
         res.event_id, coalesce(res.is_first, false) AS is_first, res.key,
         CASE WHEN coalesce(res.is_first, false) THEN CASE WHEN it.event_type = 'purchase' THEN 2 ELSE 1 END ELSE 0 END AS n_deliveries
  FROM it LEFT JOIN res USING (n)
),
runs AS (
  SELECT pg.cycle, pg.page, pg.error_code, pg.ms,
         CASE WHEN pg.error_code IS NULL THEN pg.total END AS total,
         count(n) AS received, count(n) FILTER (status = 'filtered') AS filtered,
         count(DISTINCT key) FILTER (status = 'duplicate') AS duplicate,
         count(n) FILTER (is_first) AS fresh, coalesce(sum(n_deliveries), 0) AS deliveries
  FROM pg LEFT JOIN outc USING (cycle, page) GROUP BY ALL
)
"""
)


@query(
    "agg4_item_outcomes",
    _OUTCOMES_SQL
    + "SELECT CAST(cycle AS VARCHAR) AS ingest_id, page, idx, status, event_id, is_first, n_deliveries FROM outc",
)
def agg4_item_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = intake(spark, sf_dir).outcomes
    items = outcomes.filter(F.col("status").isin("accepted", "duplicate", "filtered", "rejected"))
    return items.select("ingest_id", "page", "idx", "status", "event_id", "is_first", "n_deliveries")


@query(
    "agg1_agg2_run_rows",
    _OUTCOMES_SQL
    + """
    SELECT CAST(cycle AS VARCHAR) AS run_group_id, page AS request_page, ms AS created_ms, 'POLL' AS trigger,
           CASE WHEN error_code IS NULL THEN 'SUCCESS' ELSE 'ERROR' END AS status,
           CASE WHEN error_code IS NULL THEN 200 END AS http_status, total AS total_record_count,
           received AS items_received, filtered AS items_filtered_out, duplicate AS items_duplicate,
           fresh AS items_new, CAST(deliveries AS BIGINT) AS deliveries_created, error_code
    FROM runs
    """,
)
def agg1_agg2_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = intake(spark, sf_dir)
    counts = audit.run_counts_of_entries(plan.entries, stored_keys(spark, sf_dir))
    return audit.run_rows_of_counts(counts, "POLL").select(
        "run_group_id",
        "request_page",
        frames.millis("created_at").alias("created_ms"),
        "trigger",
        "status",
        "http_status",
        "total_record_count",
        "items_received",
        "items_filtered_out",
        "items_duplicate",
        "items_new",
        "deliveries_created",
        "error_code",
    )


@query(
    "agg3_ingest_result",
    _OUTCOMES_SQL
    + """
    SELECT CAST(cycle AS VARCHAR) AS ingest_id, CAST(sum(received) AS BIGINT) AS received,
           CAST(sum(filtered) AS BIGINT) AS filtered_out, CAST(sum(duplicate) AS BIGINT) AS duplicates,
           CAST(sum(fresh) AS BIGINT) AS accepted, CAST(sum(deliveries) AS BIGINT) AS deliveries_created,
           0 AS rejected, count(*) AS pages
    FROM runs WHERE error_code IS NULL GROUP BY cycle
    """,
)
def agg3_ingest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit.run_counts(intake(spark, sf_dir).outcomes)
    return audit.ingest_result(counts).drop("pipeline_id", "run_id")


@query(
    "agg8_counters_intake",
    _OUTCOMES_SQL
    + """
    SELECT metric, 'coleta' AS pipeline_id, 'http-poll' AS source_kind, value FROM (
      SELECT 'gateway.items.received' AS metric, CAST(sum(received) AS BIGINT) AS value FROM runs
      UNION ALL SELECT 'gateway.items.filtered', CAST(sum(filtered) AS BIGINT) FROM runs
      UNION ALL SELECT 'gateway.items.deduplicated', CAST(sum(duplicate) AS BIGINT) FROM runs
      UNION ALL SELECT 'gateway.items.accepted', CAST(sum(fresh) AS BIGINT) FROM runs)
    """,
)
def agg8_counters_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit.run_counts(intake(spark, sf_dir).outcomes)
    counted = audit.metrics_counters(counts=counts, source_kind="http-poll")
    return counted.select("metric", "pipeline_id", "source_kind", "value")


@query(
    "agg9_page_items_histogram",
    f"""
    WITH {PAGES_SQL}
    SELECT 'coleta' AS pipeline_id, count(*) AS n, CAST(sum(n_items) AS BIGINT) AS total, min(n_items) AS low, max(n_items) AS high,
           count(*) FILTER (n_items <= 0) AS le_0, count(*) FILTER (n_items > 0 AND n_items <= 50) AS le_50,
           count(*) FILTER (n_items > 50 AND n_items <= 100) AS le_100, count(*) FILTER (n_items > 100) AS le_inf
    FROM pg WHERE error_code IS NULL
    """,
)
def agg9_page_items_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit.run_counts(intake(spark, sf_dir).outcomes)
    pages = counts.filter(F.col("error_code").isNull())
    return audit.metrics_histograms(pages, "items_received", ["pipeline_id"], [0, 50, 100])


# --- endpoint runs ---------------------------------------------------------

# requests that were admitted, their items, and what became of each
_REQUESTS_SQL = """
WITH raw AS (
  SELECT event_id AS n, event_id // 5 AS r, row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id) - 1 AS idx,
         user_id, event_type, ts, value, props, @NOTE@ AS note
  FROM events
),
req AS (SELECT r, min(ts) AS t0 FROM raw GROUP BY r HAVING r % 17 <> 3),
item AS (
  SELECT raw.*, t0, event_type <> 'error' AS keep,
         CASE WHEN r % 6 = 0 THEN 'header:idempotency-key=k-' || (r // 12)
              WHEN note <> '' THEN 'field:code=' || user_id || '|field:type=' || event_type || '|field:note=' || note END AS src
  FROM raw JOIN req USING (r) WHERE r % 17 <> 5
),
firsts AS (
  SELECT *, first_value(r) OVER (PARTITION BY src ORDER BY t0, CAST(r AS VARCHAR), idx) AS first_r,
         first_value(t0) OVER (PARTITION BY src ORDER BY t0, CAST(r AS VARCHAR), idx) AS first_t0,
         row_number() OVER (PARTITION BY src ORDER BY t0, CAST(r AS VARCHAR), idx) AS nth
  FROM item WHERE keep AND src IS NOT NULL
),
outc AS (
  SELECT item.r, item.n, CASE WHEN NOT item.keep THEN 'filtered' WHEN item.src IS NULL THEN 'rejected'
              WHEN firsts.r = firsts.first_r THEN 'accepted' ELSE 'duplicate' END AS status,
         firsts.src AS key, coalesce(firsts.nth = 1, false) AS is_first, item.idx,
         CASE WHEN firsts.src IS NOT NULL THEN @EVENT@ END AS event_id
  FROM item LEFT JOIN firsts USING (n)
),
runs AS (
  SELECT req.r, req.r % 17 = 5 AS unsplit, count(n) AS received, count(n) FILTER (is_first) AS accepted,
         count(DISTINCT key) FILTER (status = 'duplicate') AS duplicates,
         count(n) FILTER (status = 'filtered') AS filtered,
         count(n) FILTER (status = 'rejected') + CASE WHEN req.r % 17 = 5 THEN 1 ELSE 0 END AS rejected,
         count(n) FILTER (status IN ('accepted', 'duplicate')) AS keyed
  FROM req LEFT JOIN outc USING (r) GROUP BY req.r
)
""".replace("@EVENT@", sql_uuid7("epoch_us(first_t0) // 1000", "'recepcao|' || sha256(firsts.src)"))


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.sources.requests import read_requests

    requests = read_requests(frames.landed_requests(spark, sf_dir))
    spec = frames.endpoint_flow()
    docs = request_documents(requests, spec.id)
    return plan_intake(docs, spec, frames.NOW).outcomes


@query(
    "agg5_request_response",
    _REQUESTS_SQL
    + """
    SELECT CAST(r AS VARCHAR) AS ingest_id, received, accepted, duplicates, filtered, rejected,
           CASE WHEN accepted = 0 AND rejected = 0 AND duplicates > 0 THEN 200
                WHEN accepted = 0 AND rejected > 0 THEN 400 ELSE 202 END AS http_status,
           coalesce(items, '') AS items
    FROM runs LEFT JOIN (SELECT r, string_agg(idx || ':' || status || ':' || coalesce(event_id, ''), ',' ORDER BY idx) AS items FROM outc GROUP BY r) USING (r)
    """,
)
def agg5_request_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = audit.request_response(request_outcomes(spark, sf_dir))
    return responses.select(
        "ingest_id",
        "received",
        "accepted",
        "duplicates",
        "filtered",
        "rejected",
        "http_status",
        F.array_join(F.transform("items", _item_text), ",").alias("items"),
    )


def _item_text(item: Column) -> Column:
    return F.concat_ws(":", item["index"].cast("string"), item["status"], F.coalesce(item["event_id"], F.lit("")))


@query(
    "agg2_partial_runs",
    _REQUESTS_SQL
    + """
    SELECT CASE WHEN keyed = 0 AND rejected > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
           count(*) AS n, CAST(sum(rejected) AS BIGINT) AS rejected
    FROM runs GROUP BY 1
    """,
)
def agg2_partial_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = audit.run_status(audit.run_counts(request_outcomes(spark, sf_dir)))
    return runs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("items_rejected").alias("rejected")
    )


@query(
    "agg8_counters_ingress",
    """
    WITH gate AS (@GATE@)
    SELECT 'gateway.ingress.rejected' AS metric, pipeline_id, CAST(status AS VARCHAR) AS reason, count(*) AS value
    FROM gate WHERE status IS NOT NULL GROUP BY ALL
    """,
)
def agg8_counters_ingress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = audit.metrics_counters(gated=gated_requests(spark, sf_dir))
    return counted.select("metric", "pipeline_id", "reason", "value")


@query(
    "agg9_body_size_histogram",
    """
    SELECT lang, count(*) AS n, CAST(sum(b) AS BIGINT) AS total, min(b) AS low, max(b) AS high,
           count(*) FILTER (b <= 1024) AS le_1024, count(*) FILTER (b > 1024 AND b <= 16384) AS le_16384, count(*) FILTER (b > 16384) AS le_inf
    FROM (SELECT lang, strlen(text) AS b FROM documents) GROUP BY lang
    """,
)
def agg9_body_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    sized = docs.select("lang", F.octet_length("text").cast("bigint").alias("body_bytes"))
    return audit.metrics_histograms(sized, "body_bytes", ["lang"], [1024, 16384])


@query(
    "win2_rate_counts",
    """
    SELECT event_type, epoch_ms(date_trunc('minute', ts)) AS minute_ms, count(*) AS n
    FROM events GROUP BY ALL
    """,
)
def win2_rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming.rates import rate_counts

    events = frames.table(spark, sf_dir, "events").withColumn("ts", frames.utc("ts"))
    counted = rate_counts(events, by="event_type", ts="ts")
    return counted.select("event_type", frames.millis("minute").alias("minute_ms"), "n")


# --- retention -------------------------------------------------------------


@query(
    "ret1_purge_candidates",
    """
    WITH victims AS (
      SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 2000 DAYS
      ORDER BY o_orderdate, 'e' || o_orderkey LIMIT 500
    )
    SELECT 'e' || o_orderkey AS id, epoch_ms(o_orderdate) AS created_ms FROM victims WHERE o_orderkey % 5 NOT IN (0, 1, 2)
    """,
)
def ret1_purge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retention.purge_candidates(
        frames.stored_events(spark, sf_dir),
        frames.deliveries(spark, sf_dir),
        frames.DELIVERY_NOW,
        days=2000,
        batch_size=500,
    )
    return found.select("id", frames.millis("created_at").alias("created_ms"))


@query(
    "ret2_month_partition",
    "SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY 1",
)
def ret2_month_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = frames.table(spark, sf_dir, "orders")
    month = month_partition(frames.utc("o_orderdate")).alias("month")
    return orders.groupBy(month).agg(F.count(F.lit(1)).alias("n"))


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = frames.table(spark, sf_dir, "orders").withColumn("created_at", frames.utc("o_orderdate"))
    return retention.months_of(orders, "pipeline_delivery").unionAll(
        retention.months_of(orders, "pipeline_run")
    )


@query(
    "ret3_partitions_expired",
    """
    SELECT DISTINCT t.table_name, strftime(o_orderdate, '%Y%m') AS month
    FROM orders, (VALUES ('pipeline_delivery', DATE '1999-09-01'), ('pipeline_run', DATE '2000-01-01')) t(table_name, cutoff)
    WHERE o_orderdate < cutoff
    """,
)
def ret3_partitions_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = retention.policy_frame(spark)
    return retention.partitions_expired(policy, _months(spark, sf_dir), datetime(2000, 3, 15))


@query(
    "ret4_out_of_horizon",
    """
    SELECT t.table_name, strftime(o_orderdate, '%Y%m') AS month, count(*) AS n_rows
    FROM orders, (VALUES ('pipeline_delivery'), ('pipeline_run')) t(table_name)
    WHERE o_orderdate < DATE '2000-02-01' OR o_orderdate >= DATE '2000-07-01' GROUP BY ALL
    """,
)
def ret4_out_of_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = retention.policy_frame(spark)
    return retention.out_of_horizon(_months(spark, sf_dir), policy, datetime(2000, 3, 15))


@query(
    "aud1_double_delivery",
    """
    SELECT 'https://origin.example/o' AS source_url, o_orderpriority AS items_path, 'https://d.example/' || (o_custkey % 2) AS request_url,
           count(DISTINCT o_orderstatus) AS n_pipelines, count(*) AS n_deliveries
    FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1
    """,
)
def aud1_double_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.table(spark, sf_dir, "orders").select(
        F.lit("https://origin.example/o").alias("source_url"),
        F.col("o_orderpriority").alias("items_path"),
        F.concat(F.lit("https://d.example/"), (F.col("o_custkey") % 2).cast("string")).alias("request_url"),
        F.col("o_orderstatus").alias("pipeline_id"),
    )
    return audit.double_delivery_rows(rows)


# --- redaction -------------------------------------------------------------


@query(
    "red1_mask_headers",
    """
    SELECT event_id, 'Bearer ***[' || substr(sha256('Bearer ' || event_type || event_id), 1, 8) || ']' AS authorization_,
           '***[' || substr(sha256('k' || user_id), 1, 8) || ']' AS x_session_token, event_type AS accept, 3 AS n_headers
    FROM events
    """,
)
def red1_mask_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.create_map(
        F.lit("Authorization"),
        F.concat(F.lit("Bearer "), F.col("event_type"), F.col("event_id").cast("string")),
        F.lit("X-Session-Token"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")),
        F.lit("Accept"),
        F.col("event_type"),
        F.lit("Gone"),
        F.lit(None).cast("string"),
    )
    events = frames.table(spark, sf_dir, "events")
    masked = events.select("event_id", mask_headers(headers).alias("h"))
    return masked.select(
        "event_id",
        F.col("h")["authorization"].alias("authorization_"),
        F.col("h")["x-session-token"].alias("x_session_token"),
        F.col("h")["accept"].alias("accept"),
        F.size("h").alias("n_headers"),
    )


@query(
    "red2_mask_url",
    """
    SELECT page_id,
           CASE WHEN page_id % 2 = 0 THEN url
                ELSE scheme || '://' || host || path || '?' || CASE WHEN old = '' THEN '' ELSE old || '&' END
                     || 'access_token=***%5B' || substr(sha256('v' || page_id), 1, 8) || '%5D' || frag END AS masked
    FROM (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
                 regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS old,
                 regexp_extract(url, '(#.*)$', 1) AS frag FROM pages)
    """,
)
def red2_mask_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other URL carries user info and a token parameter."""
    pages = frames.table(spark, sf_dir, "pages")
    base, frag = F.regexp_replace("url", "#.*$", ""), F.regexp_extract("url", "(#.*)$", 1)
    joint = F.when(F.instr(base, "?") > 0, "&").otherwise("?")
    token = F.concat(joint, F.lit("access_token=v"), F.col("page_id").cast("string"))
    with_user = F.regexp_replace(base, "^(https?://)", "$1user:pw@")
    laden = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(with_user, token, frag))
    return pages.select("page_id", mask_url(laden).alias("masked"))


@query(
    "red3_mask_body",
    """
    SELECT conv_id, turn, '***[' || substr(sha256(text), 1, 8) || ']' AS password,
           CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...[truncado]' ELSE text END AS said, turn AS kept
    FROM conversations
    """,
)
def red3_mask_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = frames.table(spark, sf_dir, "conversations")
    text = F.to_json(F.col("text").cast("variant"))
    raw = F.concat(
        F.lit('{"user":{"password":'),
        text,
        F.lit(',"said":['),
        text,
        F.lit("]},"),
        F.lit('"turn":'),
        F.col("turn").cast("string"),
        F.lit("}"),
    )
    masked = turns.select("conv_id", "turn", F.parse_json(mask_body(raw)).alias("m"))
    return masked.select(
        "conv_id",
        "turn",
        F.try_variant_get("m", "$.user.password", "string").alias("password"),
        F.try_variant_get("m", "$.user.said[0]", "string").alias("said"),
        F.try_variant_get("m", "$.turn", "bigint").alias("kept"),
    )


@query(
    "red4_mask_error",
    """
    SELECT doc_id, 'HTTP_500' AS error_code, substr(replace(m, 'tok-known-secret-1', '***[' || substr(sha256('tok-known-secret-1'), 1, 8) || ']'), 1, 2000) AS error_message
    FROM (SELECT doc_id, 'refused tok-known-secret-1: ' || text AS m FROM documents)
    """,
)
def red4_mask_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        F.lit("HTTP_500").alias("error_code"),
        F.concat(F.lit("refused tok-known-secret-1: "), F.col("text")).alias("error_message"),
    )
    return mask_error(rows, ["tok-known-secret-1", "admin"])


@query(
    "red5_scrub",
    """
    SELECT conv_id, turn, CASE WHEN length(s) > 2000 THEN substr(s, 1, 2000) || '...[truncado]' ELSE s END AS scrubbed
    FROM (SELECT conv_id, turn, replace(text || ' key=sk-live-12345678 admin', 'sk-live-12345678', '***[' || substr(sha256('sk-live-12345678'), 1, 8) || ']') AS s FROM conversations)
    """,
)
def red5_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = frames.table(spark, sf_dir, "conversations")
    leaked = F.concat(F.col("text"), F.lit(" key=sk-live-12345678 admin"))
    return turns.select(
        "conv_id", "turn", scrub(leaked, ["sk-live-12345678", "admin"]).alias("scrubbed")
    )


def _fill() -> None:
    from sluice.plans.queries_items import NOTE
    from sluice.plans.registry import ORACLES

    gate = ORACLES["gat1_ingress_gate"]
    for name, sql in ORACLES.items():
        ORACLES[name] = sql.replace("@NOTE@", NOTE).replace("@GATE@", gate)


_fill()
