"""Queries over landed pages and requests: sources, split, ledger, fan-out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.ids import uuid7_of
from sluice.functions.redact import normalize_headers
from sluice.operators import dedupe
from sluice.operators.fanout import assert_unique_deliveries, missing_deliveries
from sluice.operators.ingress import ingress_gate, normalize_route, rate_gate
from sluice.operators.split import split_items
from sluice.plans import frames
from sluice.plans.frames import millis
from sluice.plans.intake import dry_run, dry_run_summary, entries, plan_intake
from sluice.plans.registry import query
from sluice.sources.pages import page_documents, read_pages
from sluice.sources.requests import read_requests, split_invalid
from sluice.sources.tables import collection_window

LEDGER_UNTIL = datetime(2024, 1, 15)


def sql_uuid7(ms: str, material: str) -> str:
    """The SQL text of the same time-ordered id."""
    tail = f"sha256({material})"
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({tail}, 4, 1)) - 1) % 4 + 1, 1)"
    stamp = f"lpad(lower(to_hex(CAST({ms} AS BIGINT))), 12, '0')"
    return (
        f"substr({stamp}, 1, 8) || '-' || substr({stamp}, 9, 4) || '-7' || substr({tail}, 1, 3) || '-' || "
        f"{variant} || substr({tail}, 5, 3) || '-' || substr({tail}, 8, 12)"
    )


# One event as the JSON item of `frames.item_json`.
ITEM_SQL = """
'{"type":"' || event_type || '","event_id":' || event_id || ',"code":' || CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '"' || user_id || '"' END ||
',"value":' || CAST(value AS VARCHAR) || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","props":' || props || ',"flag":' ||
CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"sim"' ELSE '"x"' END ||
CASE event_id % 5 WHEN 1 THEN ',"note":null' WHEN 2 THEN ',"note":""' WHEN 3 THEN ',"note":"  n' || user_id || ' "' WHEN 4 THEN ',"note":"Nota"' ELSE '' END || '}'
""".strip()
# Landed pages as SQL: which pages a cycle keeps, and how each ends.
PAGES_SQL = """
ev AS (
  SELECT event_id AS n, event_id // 1000 AS cycle, (event_id // 100) % 10 + 1 AS page,
         row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS idx,
         user_id, event_type, ts, regexp_extract(props, '([0-9]+)', 1) AS k
  FROM events
),
landed AS (
  SELECT cycle, page, count(*) AS n_events,
         CASE WHEN cycle % 7 = 2 AND page = 4 THEN 'HTTP_503'
              WHEN cycle % 5 = 3 AND page = 6 THEN 'INVALID_JSON' END AS error_code,
         CASE WHEN cycle % 6 = 4 AND page = 8 THEN 0 ELSE count(*) END AS n_items,
         CASE WHEN cycle % 4 = 1 THEN 700 ELSE 1000 END AS total
  FROM ev GROUP BY cycle, page
),
upto AS (
  SELECT *, sum(n_items) OVER (PARTITION BY cycle ORDER BY page) AS collected FROM landed
),
pages_kept AS (
  SELECT cycle, page, error_code, n_items, total FROM upto a
  WHERE NOT EXISTS (SELECT 1 FROM upto b WHERE b.cycle = a.cycle AND b.page < a.page
                    AND (b.error_code IS NOT NULL OR b.n_items = 0 OR b.collected >= b.total))
),
pg AS (
  SELECT *, 1706745600000 + (cycle * 60 + page) * 1000 AS ms FROM pages_kept
),
it AS (
  SELECT ev.*, pg.ms, event_type IN ('click', 'purchase') AND user_id <> 0 AS keep,
         'field:code=' || user_id || '|field:type=' || event_type || '|field:props.k=' || k AS src
  FROM ev JOIN pg USING (cycle, page) WHERE pg.error_code IS NULL AND pg.n_items > 0
)
"""
RUN_ID = sql_uuid7("ms", "'coleta|' || cycle || '|' || page")
LEDGER_SQL = """
led AS (
  SELECT sha256('field:code=' || user_id || '|field:type=' || event_type || '|field:props.k=' ||
                regexp_extract(props, '([0-9]+)', 1)) AS dedupe_key,
         'L' || min(event_id) AS orig
  FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1
)
"""
KEYED_SQL = (
    PAGES_SQL
    + ","
    + LEDGER_SQL
    + """,
keyed AS (
  SELECT *, sha256(src) AS key,
         row_number() OVER (PARTITION BY src ORDER BY ms, idx) AS nth,
         first_value(ms) OVER (PARTITION BY src ORDER BY ms, idx) AS first_ms
  FROM it WHERE keep
),
res AS (
  SELECT keyed.*, orig, orig IS NULL AND ms = first_ms AS accepted,
         orig IS NULL AND nth = 1 AS is_first,
         coalesce(orig, """
    + sql_uuid7("first_ms", "'coleta|' || key")
    + """) AS event_id
  FROM keyed LEFT JOIN led ON led.dedupe_key = keyed.key
)
"""
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_documents(frames.landed_pages(spark, sf_dir), frames.poll_flow())


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept earlier: one per key among everything before mid-January."""
    events = frames.table(spark, sf_dir, "events").filter(F.col("ts") < F.lit(LEDGER_UNTIL))
    source = F.concat(
        F.lit("field:code="),
        F.col("user_id").cast("string"),
        F.lit("|field:type="),
        F.col("event_type"),
        F.lit("|field:props.k="),
        F.regexp_extract("props", "([0-9]+)", 1),
    )
    return (
        events.groupBy(F.sha2(source, 256).alias("dedupe_key"))
        .agg(F.min("event_id").alias("n"))
        .select(
            F.lit("coleta").alias("pipeline_id"),
            "dedupe_key",
            F.concat(F.lit("L"), F.col("n").cast("string")).alias("id"),
            F.lit(LEDGER_UNTIL).cast("timestamp").alias("created_at"),
        )
    )


def intake(spark: SparkSession, sf_dir: str, with_ledger: bool = True):
    """The poll intake, lazily: nothing is written."""
    docs = documents(spark, sf_dir)
    seen = ledger(spark, sf_dir) if with_ledger else None
    return plan_intake(docs, frames.poll_flow(), frames.NOW, seen)


# --- sources ---------------------------------------------------------------


@query(
    "src1_read_pages",
    f"""
    WITH {PAGES_SQL}
    SELECT cycle AS cycle_id, page, error_code, error_code IS DISTINCT FROM 'INVALID_JSON' AS has_doc
    FROM landed
    """,
)
def src1_read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(frames.landed_pages(spark, sf_dir)).select(
        "cycle_id", "page", "error_code", F.col("doc").isNotNull().alias("has_doc")
    )


@query(
    "src1_wrap_non_objects",
    """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"value":[' || doc_id || ']}'
                                   WHEN 1 THEN '{"value":' || n_chars || '}'
                                   WHEN 2 THEN '{"value":"' || lang || '"}'
                                   ELSE '{"lang":"' || lang || '"}' END AS doc
    FROM documents
    """,
)
def src1_wrap_non_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    quoted = F.concat(F.lit('"'), F.col("lang"), F.lit('"'))
    body = (
        F.when(n % 4 == 0, F.concat(F.lit(" ["), n.cast("string"), F.lit("] ")))
        .when(n % 4 == 1, F.col("n_chars").cast("string"))
        .when(n % 4 == 2, quoted)
        .otherwise(F.concat(F.lit('{"lang":'), quoted, F.lit("}")))
    )
    pages = docs.select("doc_id", F.lit(1).alias("page"), body.alias("body"))
    return read_pages(pages).select("doc_id", F.to_json("doc").alias("doc"))


@query(
    "src2_read_requests",
    f"""
    WITH item AS (SELECT event_id AS n, {ITEM_SQL} AS j FROM events),
    r AS (SELECT n // 5 AS request_id, string_agg(j, ',' ORDER BY n) AS items FROM item GROUP BY 1),
    b AS (
      SELECT request_id, CASE WHEN request_id % 17 = 3 THEN '{{"eventos":[' || items WHEN request_id % 17 = 5 THEN '[' || items || ']'
                              ELSE '{{"eventos":[' || items || ']}}' END AS body FROM r
    )
    SELECT request_id, request_id % 17 <> 3 AS has_doc, request_id % 17 = 5 AS wrapped,
           'application/json' AS content_type, 1 AS page, strlen(body) AS body_bytes, sha256(body) AS body_sha256
    FROM b
    """,
)
def src2_read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read_requests(frames.landed_requests(spark, sf_dir))
    return requests.select(
        "request_id",
        F.col("doc").isNotNull().alias("has_doc"),
        F.coalesce(F.try_variant_get("doc", "$.value", "variant").isNotNull(), F.lit(False)).alias("wrapped"),
        "content_type",
        "page",
        F.col("body_bytes").cast("bigint").alias("body_bytes"),
        "body_sha256",
    )


@query(
    "src3_normalize_headers",
    """
    SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'second' ELSE event_type || ', b' END AS x_kind,
           CAST(event_id AS VARCHAR) AS accept, CASE WHEN event_id % 4 = 3 THEN 1 ELSE 2 END - CASE WHEN event_id % 4 = 3 THEN -1 ELSE 0 END AS n_headers
    FROM events
    """,
)
def src3_normalize_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("event_id").cast("string")
    first = F.create_map(
        F.lit("X-Kind"),
        F.array("event_type", F.lit("b")),
        F.lit("ACCEPT"),
        F.array(text),
        F.lit("Gone"),
        F.lit(None).cast("array<string>"),
    )
    twice = F.map_concat(first, F.create_map(F.lit("x-kind"), F.array(F.lit("second"))))
    events = frames.table(spark, sf_dir, "events")
    headers = normalize_headers(F.when(F.col("event_id") % 4 == 3, twice).otherwise(first))
    staged = events.select("event_id", headers.alias("h"))
    return staged.select(
        "event_id",
        F.col("h")["x-kind"].alias("x_kind"),
        F.col("h")["accept"].alias("accept"),
        F.size("h").alias("n_headers"),
    )


@query(
    "src4_invalid_bodies",
    """
    SELECT DISTINCT event_id // 5 AS request_id, 400 AS status, 'invalid_body' AS error
    FROM events WHERE (event_id // 5) % 17 = 3
    """,
)
def src4_invalid_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = split_invalid(read_requests(frames.landed_requests(spark, sf_dir)))
    return invalid.select("request_id", "status", "error")


@query(
    "src5_src6_pages_kept",
    f"""
    WITH {PAGES_SQL}
    SELECT CAST(cycle AS VARCHAR) AS ingest_id, page, error_code, {RUN_ID} AS run_id,
           CASE error_code WHEN 'HTTP_503' THEN 'pagina ' || page || ' respondeu HTTP 503'
                           WHEN 'INVALID_JSON' THEN 'pagina ' || page || ' nao devolveu JSON' END AS error_message,
           CASE WHEN error_code IS NULL THEN total END AS total_record_count
    FROM pg
    """,
)
def src5_src6_pages_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "ingest_id", "page", "error_code", "run_id", "error_message", "total_record_count"
    )


@query(
    "src7_collection_window",
    """
    SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-12-29' AND o_orderdate < TIMESTAMP '1999-01-03'
    GROUP BY o_orderstatus
    """,
)
def src7_collection_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 01:30 UTC on the 1st is still the 31st in Sao Paulo
    kept = collection_window(
        frames.table(spark, sf_dir, "orders"),
        "o_orderdate",
        "{today-2d}",
        "{today+2d}",
        F.to_timestamp(F.lit("1999-01-01T01:30:00Z")),
        "America/Sao_Paulo",
    )
    return kept.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )


# --- split -----------------------------------------------------------------


@query(
    "spl1_spl3_items",
    f"""
    WITH {PAGES_SQL}
    SELECT CAST(cycle AS VARCHAR) AS ingest_id, page, idx, n AS event_id FROM it
    """,
)
def spl1_spl3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = split_items(documents(spark, sf_dir), "itens")
    return items.select(
        "ingest_id",
        "page",
        F.col("idx").cast("bigint").alias("idx"),
        F.try_variant_get("item", "$.event_id", "bigint").alias("event_id"),
    )


@query(
    "spl2_split_errors",
    f"""
    SELECT DISTINCT event_id // 5 AS request_id, '{M.ITEMS_PATH_NOT_FOUND}' AS reason,
           'itemsPath ''eventos'' ausente no corpo' AS detail
    FROM events WHERE (event_id // 5) % 17 = 5
    """,
)
def spl2_split_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = split_invalid(read_requests(frames.landed_requests(spark, sf_dir)))
    _, rejected = split_items(valid, "eventos")
    return rejected.select("request_id", "reason", "detail")


# --- ledger ----------------------------------------------------------------


@query(
    "dup1_dedupe_batch",
    f"""
    WITH {KEYED_SQL}
    SELECT key AS dedupe_key, CAST(cycle AS VARCHAR) AS ingest_id, page, idx,
           (SELECT count(*) FROM keyed k WHERE k.key = keyed.key) - 1 AS surplus
    FROM keyed WHERE nth = 1
    """,
)
def dup1_dedupe_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(documents(spark, sf_dir), frames.poll_flow()).filter(F.col("state") == "keyed")
    first = dedupe.dedupe_batch(rows)
    return first.select(
        "dedupe_key", "ingest_id", "page", F.col("idx").cast("bigint").alias("idx"), "surplus"
    )


@query(
    "dup2_evt1_new_events",
    f"""
    WITH {KEYED_SQL}
    SELECT event_id AS id, ms AS created_ms, key AS dedupe_key, src AS dedupe_source, {RUN_ID} AS run_id
    FROM res WHERE is_first
    """,
)
def dup2_evt1_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake(spark, sf_dir).events.select(
        "id", millis("created_at").alias("created_ms"), "dedupe_key", "dedupe_source", "run_id"
    )


@query(
    "dup3_resolve_duplicates",
    f"""
    WITH {KEYED_SQL}
    SELECT key AS dedupe_key, orig AS event_id, count(*) AS n_items
    FROM res WHERE orig IS NOT NULL GROUP BY 1, 2
    """,
)
def dup3_resolve_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(documents(spark, sf_dir), frames.poll_flow()).filter(F.col("state") == "keyed")
    found = dedupe.resolve_duplicates(rows, ledger(spark, sf_dir))
    return found.select("dedupe_key", "event_id", "n_items")


@query(
    "dup4_page_order",
    f"""
    WITH {KEYED_SQL}
    SELECT CAST(cycle AS VARCHAR) AS ingest_id, page,
           count(*) FILTER (ms = first_ms) AS accepted, count(*) FILTER (ms <> first_ms) AS duplicate
    FROM keyed GROUP BY 1, 2
    """,
)
def dup4_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = intake(spark, sf_dir, with_ledger=False).outcomes
    keyed = outcomes.filter(F.col("status").isin("accepted", "duplicate"))
    return keyed.groupBy("ingest_id", "page").agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate"),
    )


@query(
    "dup5_find_events",
    f"""
    WITH {LEDGER_SQL}
    SELECT dedupe_key, orig AS id FROM led
    WHERE dedupe_key IN (SELECT sha256('field:code=' || user_id || '|field:type=error|field:props.k=' ||
                                regexp_extract(props, '([0-9]+)', 1)) FROM events)
    """,
)
def dup5_find_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(
        F.lit("field:code="),
        F.col("user_id").cast("string"),
        F.lit("|field:type=error|field:props.k="),
        F.regexp_extract("props", "([0-9]+)", 1),
    )
    keys = frames.table(spark, sf_dir, "events").select(F.sha2(source, 256).alias("dedupe_key"))
    return dedupe.find_events(ledger(spark, sf_dir), "coleta", keys).select("dedupe_key", "id")


@query(
    "evt1_event_rows",
    f"""
    WITH {KEYED_SQL}
    SELECT pipe AS pipeline_id, substr(src, 1, 500) AS dedupe_source, ms AS run_created_ms,
           length(payload) AS payload_bytes, sha256(payload) AS payload_hash
    FROM (SELECT 'coleta' AS pipe, src, ms, (SELECT canonical FROM canon WHERE canon.event_id = res.n) AS payload
          FROM res WHERE is_first)
    """.replace(
        "WITH ", "WITH canon AS (SELECT event_id, @CANONICAL@ AS canonical FROM events), ", 1
    ),
)
def evt1_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake(spark, sf_dir).events.select(
        "pipeline_id",
        "dedupe_source",
        millis("run_created_at").alias("run_created_ms"),
        F.col("payload_bytes").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_hash"),
    )


@query(
    "evt2_uuid7",
    f"SELECT event_id, {sql_uuid7('epoch_us(ts) // 1000', 'event_type || chr(124) || user_id')} AS id FROM events",
)
def evt2_uuid7(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frames.table(spark, sf_dir, "events")
    made = uuid7_of(frames.utc("ts"), F.col("event_type"), F.col("user_id").cast("string"))
    return events.select("event_id", made.alias("id"))


# --- fan-out ---------------------------------------------------------------

DELIVERY_SQL = f"""
WITH {KEYED_SQL},
dest AS (SELECT * FROM (VALUES ('todos', 5), ('compras', 3)) t(destination_id, max_attempts)),
dlv AS (
  SELECT res.*, destination_id, max_attempts,
         {sql_uuid7("ms", "event_id || chr(124) || destination_id")} AS id
  FROM res, dest WHERE is_first AND (destination_id = 'todos' OR event_type = 'purchase')
)
"""


@query(
    "fan1_deliveries_by_destination",
    DELIVERY_SQL
    + """
    SELECT destination_id, count(*) AS n, count(DISTINCT event_id) AS n_events, min(dedupe_key_) AS low_key
    FROM (SELECT *, key AS dedupe_key_ FROM dlv) GROUP BY destination_id
    """,
)
def fan1_deliveries_by_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake(spark, sf_dir).deliveries
    return rows.groupBy("destination_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("event_id").alias("n_events"),
        F.min("dedupe_key").alias("low_key"),
    )


@query(
    "fan2_fan3_deliveries",
    DELIVERY_SQL
    + """
    SELECT id, ms AS created_ms, 'coleta' AS pipeline_id, destination_id, event_id, key AS dedupe_key,
           'PENDING' AS status, 0 AS attempt_count, max_attempts, 1706745600000 AS next_attempt_ms,
           CASE destination_id WHEN 'todos' THEN 'https://dest.example/todos?token=***%5B' || substr(sha256('abc'), 1, 8) || '%5D&x=1'
                               ELSE 'https://dest.example/compras' END AS request_url
    FROM dlv
    """,
)
def fan2_fan3_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake(spark, sf_dir).deliveries
    return rows.select(
        "id",
        millis("created_at").alias("created_ms"),
        "pipeline_id",
        "destination_id",
        "event_id",
        "dedupe_key",
        "status",
        "attempt_count",
        "max_attempts",
        millis("next_attempt_at").alias("next_attempt_ms"),
        "request_url",
    )


@query(
    "fan4_unique_deliveries",
    DELIVERY_SQL + "SELECT event_id, destination_id, CAST(2 AS BIGINT) AS n FROM dlv WHERE ms >= 1706745600000 + 120000",
)
def fan4_unique_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if the deliveries from the third cycle on had been written twice."""
    made = intake(spark, sf_dir).deliveries
    again = made.filter(F.col("created_at") >= F.timestamp_millis(F.lit(1706745600000 + 120000)))
    return assert_unique_deliveries(made.unionByName(again))


@query(
    "fan1_repair_lost_deliveries",
    DELIVERY_SQL + "SELECT DISTINCT event_id AS id FROM dlv WHERE ms >= 1706745600000 + 120000",
)
def fan1_repair_lost_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if the delivery write had been lost from the third cycle on."""
    plan = intake(spark, sf_dir)
    bound = F.timestamp_millis(F.lit(1706745600000 + 120000))
    written = plan.deliveries.filter(F.col("created_at") < bound)
    return missing_deliveries(plan.events, written).select("id")


# --- dry run ---------------------------------------------------------------


@query(
    "pln1_dry_run",
    f"""
    WITH {PAGES_SQL}
    SELECT 'coleta' AS pipeline_id, count(*) AS received, count(*) FILTER (NOT keep) AS filtered,
           0 AS no_key_or_transform, count(*) FILTER (keep) AS ready
    FROM it
    """,
)
def pln1_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dry_run_summary(documents(spark, sf_dir), frames.poll_flow())


@query(
    "pln1_body_preview",
    f"""
    WITH {PAGES_SQL}
    SELECT n AS event_id, src AS dedupe_source,
           '{{"codigo":' || user_id || ',"evento":{{"id":' || n || ',"tipo":"' || upper(event_type) || '"}},"k":' || k ||
           CASE WHEN n % 5 > 1 THEN ',"nota":"' || CASE n % 5 WHEN 2 THEN '' WHEN 3 THEN 'n' || user_id ELSE 'Nota' END || '"' ELSE '' END ||
           ',"origem":"poll"}}' AS body
    FROM it WHERE keep
    """,
)
def pln1_body_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = dry_run(documents(spark, sf_dir), frames.poll_flow())
    ready = plan.filter(F.col("verdict") == "ready")
    return ready.select(
        F.regexp_extract("body", '"id":([0-9]+)', 1).cast("bigint").alias("event_id"),
        "dedupe_source",
        "body",
    )


# --- ingress ---------------------------------------------------------------

REQUESTS_SQL = """
req AS (
  SELECT event_id // 5 AS r, min(ts) AS t0 FROM events GROUP BY 1
),
checked AS (
  SELECT r, t0, CASE WHEN r % 13 = 4 THEN 404 WHEN r % 11 = 0 THEN 401 WHEN r % 19 = 7 THEN 405 END AS early FROM req
)
"""


@query(
    "win1_rate_gate",
    """
    SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS within_rate
    FROM events
    """,
)
def win1_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frames.table(spark, sf_dir, "events")
    gated = rate_gate(events, 1, by="event_type", ts="ts", request_id="event_id")
    return gated.select("event_id", "within_rate")


@query(
    "win1_rate_gate_one_hour_flow",
    """
    SELECT o_orderstatus, count(*) FILTER (nth <= 5) AS passed, count(*) FILTER (nth > 5) AS refused
    FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus, date_trunc('minute', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
    GROUP BY o_orderstatus
    """,
)
def win1_rate_gate_one_hour_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = frames.table(spark, sf_dir, "orders")
    gated = rate_gate(orders, 5, by="o_orderstatus", ts="o_orderdate", request_id="o_orderkey")
    return gated.groupBy("o_orderstatus").agg(
        F.count_if("within_rate").alias("passed"), F.count_if(~F.col("within_rate")).alias("refused")
    )


def gated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = frames.landed_requests(spark, sf_dir).withColumn("body_bytes", F.octet_length("body"))
    return ingress_gate(requests, [frames.endpoint_flow(), frames.poll_flow()])


@query(
    "gat1_ingress_gate",
    f"""
    WITH canon AS (
      SELECT event_id // 5 AS r, sum(length(@CANONICAL@)) + count(*) - 1 +
             CASE WHEN (event_id // 5) % 17 = 3 THEN 12 WHEN (event_id // 5) % 17 = 5 THEN 2 ELSE 14 END
             + sum(CASE WHEN value = floor(value) THEN 2 ELSE 0 END) + sum(CASE WHEN props LIKE '%: %' THEN 1 ELSE 0 END) AS bytes
      FROM events GROUP BY 1
    ),
    {REQUESTS_SQL},
    sized AS (
      SELECT r, t0, CASE WHEN early IS NOT NULL THEN early WHEN bytes > 720 THEN 413 END AS early
      FROM checked JOIN canon USING (r)
    ),
    rated AS (
      SELECT r, early, row_number() OVER (PARTITION BY early IS NULL, date_trunc('minute', t0) ORDER BY t0, r) AS nth FROM sized
    )
    SELECT r AS request_id, CASE WHEN early = 404 THEN NULL ELSE 'recepcao' END AS pipeline_id,
           CASE WHEN early IS NOT NULL THEN early WHEN nth > 2 THEN 429 WHEN r % 17 = 3 THEN 400 END AS status
    FROM rated
    """,
)
def gat1_ingress_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_requests(spark, sf_dir).select("request_id", "pipeline_id", "status")


@query(
    "gat2_normalize_route",
    """
    SELECT page_id, '/in/' || lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?:', ''), '^/+', ''), '/+$', ''), '/{2,}', '/', 'g')) AS route
    FROM pages
    """,
)
def gat2_normalize_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frames.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("//in/"), F.regexp_replace(F.regexp_replace("url", "^https?:", ""), "^/+", ""))
    return pages.select("page_id", normalize_route(path).alias("route"))


# SQL texts above name the canonical item by a mark; put it in once.
def _fill() -> None:
    from sluice.plans.queries_items import CANONICAL
    from sluice.plans.registry import ORACLES

    for name, sql in ORACLES.items():
        ORACLES[name] = sql.replace("@CANONICAL@", CANONICAL)


_fill()
