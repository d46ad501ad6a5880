"""Queries over deliveries: attempts, the state machine, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions import retry
from sluice.operators import audit, delivery
from sluice.plans import frames
from sluice.plans.frames import DELIVERY_NOW as NOW
from sluice.plans.frames import millis
from sluice.plans.queries_intake import sql_uuid7
from sluice.plans.registry import query

NOW_MS = 996710400000

# the same deliveries and attempt results as SQL
DELIVERIES_SQL = f"""
d AS (
  SELECT o_orderkey AS n, 'd' || o_orderkey AS id, o_orderdate AS created_at, epoch_ms(o_orderdate) AS created_ms,
         'p' || (o_custkey % 3) AS pipeline_id, 'd' || (o_orderkey % 2) AS destination_id, 'e' || o_orderkey AS event_id,
         sha256('field:o_orderkey=' || o_orderkey) AS dedupe_key,
         CASE o_orderkey % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_FLIGHT' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'DELIVERED' ELSE 'DISCARDED' END AS status,
         o_orderkey % 4 AS attempt_count, 3 AS max_attempts,
         epoch_ms(o_orderdate) + (o_orderkey % 7) * 3600000 AS next_ms,
         CASE WHEN o_orderkey % 5 = 1 THEN 't' || o_orderkey END AS lease_token,
         CASE WHEN o_orderkey % 5 = 1 THEN epoch_ms(o_orderdate) + (o_orderkey % 48) * 3600000 END AS lease_ms,
         CASE WHEN o_orderkey % 3 = 0 THEN 'ECONNRESET' END AS error_code,
         o_custkey, o_orderstatus, o_orderpriority
  FROM orders
),
res AS (
  SELECT o_orderkey AS n, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE 't' END || o_orderkey AS r_token,
         CASE WHEN o_orderkey % 9 = 8 THEN 'ETIMEDOUT' END AS net_code,
         CASE o_orderkey % 9 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 408 WHEN 5 THEN 429 WHEN 6 THEN 500 WHEN 7 THEN 100 END AS code,
         o_orderkey % 700 AS duration_ms, o_orderkey % 5000 AS body_length,
         CASE WHEN o_orderkey % 9 <> 8 THEN CASE o_orderkey % 4 WHEN 0 THEN 120000 WHEN 1 THEN 600000 END END AS wait_ms
  FROM orders
),
spec AS (
  SELECT * FROM (VALUES ('p0', 'd0', 120, false, true, 15000, 'TRUNCATED'), ('p0', 'd1', 45, true, false, 1000, 'HASH_ONLY'),
                        ('p1', 'd0', 120, false, true, 15000, 'FULL')) t(pipeline_id, destination_id, lease_s, listed, expo, initial_ms, keep)
),
j AS (
  SELECT d.*, r_token, net_code, code, duration_ms, body_length, wait_ms, lease_s, listed, expo, initial_ms, keep,
         CASE WHEN net_code IS NOT NULL THEN 'RETRYABLE'
              WHEN coalesce(listed, false) AND code IN (200, 404) THEN 'SUCCESS'
              WHEN code BETWEEN 200 AND 299 AND NOT coalesce(listed, false) THEN 'SUCCESS'
              WHEN code BETWEEN 200 AND 299 THEN 'NON_RETRYABLE'
              WHEN code BETWEEN 300 AND 399 THEN 'NON_RETRYABLE'
              WHEN code BETWEEN 400 AND 499 AND code NOT IN (408, 429) THEN 'NON_RETRYABLE' ELSE 'RETRYABLE' END AS kind,
         CASE WHEN net_code IS NOT NULL THEN net_code
              WHEN code BETWEEN 200 AND 299 THEN 'HTTP_' || code || '_FORA_DE_SUCCESS_STATUSES'
              WHEN code BETWEEN 300 AND 399 THEN 'HTTP_' || code || '_REDIRECT' ELSE 'HTTP_' || code END AS why
  FROM d JOIN res USING (n) LEFT JOIN spec USING (pipeline_id, destination_id)
),
routed AS (
  SELECT *, CASE WHEN kind = 'SUCCESS' THEN 'DELIVERED' WHEN kind = 'NON_RETRYABLE' OR attempt_count >= 3 THEN 'DISCARDED' ELSE 'FAILED' END AS next_status,
         coalesce(lease_token = r_token AND lease_s IS NOT NULL, false) AS owned,
         CASE WHEN wait_ms IS NOT NULL THEN least(wait_ms, 3600000)
              WHEN expo THEN CAST(initial_ms * power(2, greatest(attempt_count - 1, 0)) AS BIGINT) ELSE initial_ms END AS delay_ms
  FROM j
)
"""


@query(
    "out1_classify",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT n, kind, CASE WHEN kind <> 'SUCCESS' THEN why END AS why FROM routed
    """,
)
def out1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivery.with_destination(
        frames.deliveries(spark, sf_dir).select("id", "pipeline_id", "destination_id"),
        frames.delivery_flows(),
    )
    results = frames.attempt_outcomes(spark, sf_dir).select(
        F.col("delivery_id").alias("id"), "net_code", F.col("status").alias("code")
    )
    verdict = retry.classify(F.col("net_code"), F.col("code"), F.col("success_statuses"))
    joined = rows.join(results, "id").select("id", verdict.alias("v"))
    return joined.select(
        F.substring("id", 2, 30).cast("bigint").alias("n"), F.col("v.kind").alias("kind"), F.col("v.why").alias("why")
    )


@query(
    "out2_retry_after",
    f"WITH {DELIVERIES_SQL} SELECT n, CAST(wait_ms AS DOUBLE) AS wait_ms FROM res",
)
def out2_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = frames.attempt_outcomes(spark, sf_dir)
    wait = retry.retry_after_ms(F.col("headers")["retry-after"], F.lit(NOW).cast("timestamp"))
    return results.select(F.substring("delivery_id", 2, 30).cast("bigint").alias("n"), wait.alias("wait_ms"))


@query(
    "out3_backoff",
    """
    SELECT o_orderkey,
           CAST(least(15000 * power(2, o_orderkey % 12), 3600000) AS BIGINT) AS exponential,
           15000 AS fixed,
           CAST(floor(least(least(1000 * power(3, o_orderkey % 12), 60000) * (0.5 + (o_custkey % 10) / 10.0), 60000) + 0.5) AS BIGINT) AS jittered,
           least(o_orderkey % 9 * 1000, 5000) AS asked
    FROM orders
    """,
)
def out3_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = frames.table(spark, sf_dir, "orders")
    attempt = (F.col("o_orderkey") % 12 + 1).cast("int")
    none, half = F.lit(None).cast("double"), F.lit(0.5)

    def delay(initial, top, factor, jitter, exponential, asked=none, draw=half):
        return retry.backoff_ms(
            attempt, F.lit(initial), F.lit(top), F.lit(float(factor)), F.lit(float(jitter)), F.lit(exponential), asked, draw
        )

    draw = (F.col("o_custkey") % 10) / 10.0
    asked = (F.col("o_orderkey") % 9 * 1000).cast("double")
    return orders.select(
        "o_orderkey",
        delay(15_000, 3_600_000, 2, 0, True).alias("exponential"),
        delay(15_000, 3_600_000, 2, 0, False).alias("fixed"),
        delay(1_000, 60_000, 3, 0.5, True, draw=draw).alias("jittered"),
        delay(1_000, 5_000, 2, 0.2, True, asked=asked).alias("asked"),
    )


_CLAIMABLE = f"""
attempt_count < 3 AND lease_s IS NOT NULL AND (status IN ('PENDING', 'FAILED') OR (status = 'IN_FLIGHT' AND lease_ms < {NOW_MS}))
"""


@query(
    "dlv1_dlv3_claim",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id, coalesce({_CLAIMABLE}, false) AS claimed,
           CASE WHEN {_CLAIMABLE} THEN 'IN_FLIGHT' ELSE status END AS status,
           CASE WHEN {_CLAIMABLE} THEN attempt_count + 1 ELSE attempt_count END AS attempt_count,
           CASE WHEN {_CLAIMABLE} THEN {NOW_MS} + lease_s * 1000 ELSE lease_ms END AS lease_expires_ms,
           CASE WHEN {_CLAIMABLE} THEN {sql_uuid7(str(NOW_MS), "id || '|' || (attempt_count + 1) || '|w1'")} ELSE lease_token END AS lease_token,
           CASE WHEN {_CLAIMABLE} THEN 'w1' END AS worker_id
    FROM j
    """,
)
def dlv1_dlv3_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.deliveries(spark, sf_dir)
    claimed = delivery.claim(rows, NOW, "w1", frames.delivery_flows())
    return claimed.select(
        "id",
        "claimed",
        "status",
        "attempt_count",
        millis("lease_expires_at").alias("lease_expires_ms"),
        "lease_token",
        "worker_id",
    )


@query(
    "dlv2_claim_miss",
    f"""
    WITH {DELIVERIES_SQL},
    asked AS (SELECT id, created_ms FROM d UNION ALL SELECT 'gone' || n, created_ms FROM d)
    SELECT asked.id, CASE WHEN d.id IS NULL THEN 'NOT_FOUND' WHEN status IN ('DELIVERED', 'DISCARDED') THEN 'ALREADY_TERMINAL'
           WHEN attempt_count >= 3 THEN 'ATTEMPTS_EXHAUSTED'
           WHEN status = 'IN_FLIGHT' AND lease_ms >= {NOW_MS} THEN 'LEASE_HELD_BY_OTHER' END AS reason
    FROM asked LEFT JOIN d USING (id)
    """,
)
def dlv2_claim_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.deliveries(spark, sf_dir)
    gone = rows.select(F.regexp_replace("id", "^d", "gone").alias("id"), "created_at")
    asked = rows.select("id", "created_at").unionAll(gone)
    return delivery.claim_miss(rows, asked, NOW).select("id", "reason")


@query(
    "dlv4_dlv7_apply_outcomes",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id, CASE WHEN owned THEN next_status ELSE status END AS status,
           CASE WHEN owned AND next_status = 'DISCARDED' THEN CASE kind WHEN 'NON_RETRYABLE' THEN 'NON_RETRYABLE_STATUS' ELSE 'ATTEMPTS_EXHAUSTED' END END AS discard_reason,
           CASE WHEN NOT owned THEN error_code WHEN next_status = 'DISCARDED' THEN why WHEN next_status = 'FAILED' THEN net_code END AS error_code,
           CASE WHEN owned AND net_code IS NOT NULL THEN 'timed out' END AS error_message,
           CASE WHEN owned AND next_status = 'FAILED' THEN {NOW_MS} + delay_ms ELSE next_ms END AS next_attempt_ms,
           CASE WHEN owned AND next_status = 'DELIVERED' THEN {NOW_MS} END AS delivered_ms,
           CASE WHEN NOT owned THEN lease_token END AS lease_token,
           CASE WHEN owned THEN code END AS response_status,
           CASE WHEN owned AND net_code IS NULL THEN CASE keep WHEN 'FULL' THEN repeat('r', body_length) WHEN 'TRUNCATED' THEN
             CASE WHEN body_length > 4096 THEN repeat('r', 4096) || 'TAIL' ELSE repeat('r', body_length) END END END AS response_body,
           CASE WHEN owned THEN sha256('{{"pedido":"' || n || '"}}') END AS request_body_sha256,
           CASE WHEN owned THEN duration_ms END AS duration_ms
    FROM routed
    """.replace("TAIL", M.TRUNCATED),
)
def dlv4_dlv7_apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = delivery.apply_outcomes(
        frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir), NOW, frames.delivery_flows()
    )
    return after.select(
        "id",
        "status",
        "discard_reason",
        "error_code",
        "error_message",
        millis("next_attempt_at").alias("next_attempt_ms"),
        millis("delivered_at").alias("delivered_ms"),
        "lease_token",
        "response_status",
        "response_body",
        "request_body_sha256",
        "duration_ms",
    )


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.attempt_results(
        frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir), NOW, frames.delivery_flows()
    )


@query(
    "dlv7_attempt_results",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id AS delivery_id, CASE WHEN kind = 'SUCCESS' THEN 'ok' WHEN next_status = 'DISCARDED' THEN 'dead' ELSE 'retry' END AS outcome,
           CASE WHEN kind = 'SUCCESS' THEN NULL WHEN kind = 'RETRYABLE' AND next_status = 'DISCARDED' THEN 'ATTEMPTS_EXHAUSTED' ELSE why END AS reason,
           owned, CASE WHEN next_status = 'FAILED' THEN delay_ms END AS delay_ms
    FROM routed WHERE lease_s IS NOT NULL
    """,
)
def dlv7_attempt_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).select("delivery_id", "outcome", "reason", "owned", "delay_ms")


@query(
    "dlv8_duplicate_detected",
    f"WITH {DELIVERIES_SQL} SELECT id AS delivery_id, pipeline_id, destination_id FROM routed WHERE kind = 'SUCCESS' AND NOT owned AND lease_s IS NOT NULL",
)
def dlv8_duplicate_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delivery.duplicate_detected(
        frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir), NOW, frames.delivery_flows()
    )
    return found.select("delivery_id", "pipeline_id", "destination_id")


@query(
    "dlv9_reconcile_spec",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id, action, CASE WHEN action = 'discard' THEN 'DISCARDED' ELSE status END AS status,
           CASE WHEN action = 'discard' THEN 'DESTINATION_REMOVED' END AS discard_reason
    FROM (SELECT *, CASE WHEN status IN ('DELIVERED', 'DISCARDED') THEN NULL WHEN pipeline_id = 'p2' THEN 'wait' WHEN lease_s IS NULL THEN 'discard' END AS action FROM j)
    """,
)
def dlv9_reconcile_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = delivery.reconcile_spec(frames.deliveries(spark, sf_dir), frames.delivery_flows(), NOW)
    return after.select("id", "action", "status", "discard_reason")


_LEVEL = "CASE WHEN n % 10 = 9 THEN 'n' ELSE '' END || substr(o_orderpriority, 1, 1)"
_GONE = "created_at < TIMESTAMP '1995-06-01'"


@query(
    "snk4_render_requests",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id AS delivery_id, 'POST' AS method,
           CASE WHEN {_GONE} OR n % 10 = 9 THEN NULL ELSE
             '{{"cliente":' || o_custkey || ',"estado":"' || lower(o_orderstatus) || '","pedido":"' || n || '","prioridade":{{"nivel":' || substr(o_orderpriority, 1, 1) || '}}}}' END AS body,
           CASE WHEN {_GONE} THEN 'EVENT_NOT_FOUND' WHEN n % 10 = 9 THEN 'TRANSFORM_FAILED' END AS err_reason,
           CASE WHEN {_GONE} THEN '{M.EVENT_PURGED}' WHEN n % 10 = 9 THEN 'campo ''nivel'': valor ''' || {_LEVEL} || ''' nao e numero' END AS err_detail,
           id AS idempotency_key, event_id AS x_event_id, CAST(attempt_count AS VARCHAR) AS attempt,
           CASE WHEN destination_id = 'd1' THEN 'text/plain' ELSE 'application/json' END AS accept,
           CASE WHEN destination_id = 'd1' THEN 6 ELSE 5 END AS n_headers
    FROM j WHERE lease_s IS NOT NULL
    """,
)
def snk4_render_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = delivery.render_requests(
        frames.deliveries(spark, sf_dir), frames.stored_events(spark, sf_dir), frames.delivery_flows()
    )
    headers = F.col("headers")
    return rendered.select(
        "delivery_id",
        "method",
        "body",
        "err_reason",
        "err_detail",
        headers["idempotency-key"].alias("idempotency_key"),
        headers["x-event-id"].alias("x_event_id"),
        headers["x-delivery-attempt"].alias("attempt"),
        headers["accept"].alias("accept"),
        F.size(headers).alias("n_headers"),
    )


@query(
    "dlv10_invalid_payload",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id, CASE WHEN bad THEN 'DISCARDED' ELSE status END AS status,
           CASE WHEN bad THEN 'INVALID_PAYLOAD' END AS discard_reason,
           CASE WHEN bad THEN CASE WHEN {_GONE} THEN 'EVENT_NOT_FOUND' ELSE 'TRANSFORM_FAILED' END ELSE error_code END AS error_code
    FROM (SELECT *, status = 'IN_FLIGHT' AND lease_s IS NOT NULL AND ({_GONE} OR n % 10 = 9) AS bad FROM j)
    """,
)
def dlv10_invalid_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.deliveries(spark, sf_dir)
    in_flight = rows.filter(F.col("status") == "IN_FLIGHT")
    rendered = delivery.render_requests(
        in_flight, frames.stored_events(spark, sf_dir), frames.delivery_flows()
    )
    after = delivery.discard_invalid(rows, rendered, NOW)
    return after.select("id", "status", "discard_reason", "error_code")


@query(
    "dlv11_retain_body",
    f"""
    SELECT doc_id, keep, CASE keep WHEN 'FULL' THEN text WHEN 'TRUNCATED' THEN CASE WHEN length(text) > 8192 THEN substr(text, 1, 8192) || '{M.TRUNCATED}' ELSE text END END AS request_body,
           CASE keep WHEN 'FULL' THEN text WHEN 'TRUNCATED' THEN CASE WHEN length(text) > 4096 THEN substr(text, 1, 4096) || '{M.TRUNCATED}' ELSE text END END AS response_body,
           strlen(text) AS request_body_bytes, sha256(text) AS request_body_sha256, substr(text, 1, 2000) AS error_message
    FROM documents, (VALUES ('FULL'), ('TRUNCATED'), ('HASH_ONLY')) t(keep)
    """,
)
def dlv11_retain_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(F.lit("FULL"), F.lit("TRUNCATED"), F.lit("HASH_ONLY")))
    docs = frames.table(spark, sf_dir, "documents").select(
        "doc_id",
        kinds.alias("persist_body"),
        F.col("text").alias("request_body"),
        F.col("text").alias("response_body"),
        F.col("text").alias("error_message"),
    )
    kept = delivery.retain_body(docs)
    return kept.select(
        "doc_id",
        F.col("persist_body").alias("keep"),
        "request_body",
        "response_body",
        "request_body_bytes",
        "request_body_sha256",
        "error_message",
    )


_EXPIRED = f"status = 'IN_FLIGHT' AND lease_ms < {NOW_MS} AND created_ms > {NOW_MS} - CAST(1000 AS BIGINT) * 86400000"


@query(
    "dlv12_reap",
    f"""
    WITH {DELIVERIES_SQL},
    orphans AS (SELECT id FROM d WHERE {_EXPIRED} ORDER BY lease_ms, id LIMIT 400)
    SELECT d.id, orphans.id IS NOT NULL AS reaped,
           CASE WHEN orphans.id IS NULL THEN status WHEN attempt_count >= 3 THEN 'DISCARDED' ELSE 'FAILED' END AS status,
           CASE WHEN orphans.id IS NOT NULL AND attempt_count >= 3 THEN 'ATTEMPTS_EXHAUSTED' END AS discard_reason,
           CASE WHEN orphans.id IS NULL THEN error_code ELSE coalesce(error_code, 'LEASE_EXPIRED') END AS error_code,
           CASE WHEN orphans.id IS NULL THEN next_ms ELSE {NOW_MS} END AS next_attempt_ms,
           CASE WHEN orphans.id IS NULL THEN lease_token END AS lease_token
    FROM d LEFT JOIN orphans USING (id)
    """,
)
def dlv12_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = delivery.reap(frames.deliveries(spark, sf_dir), NOW, lookback_days=1000, limit=400)
    return after.select(
        "id",
        "reaped",
        "status",
        "discard_reason",
        "error_code",
        millis("next_attempt_at").alias("next_attempt_ms"),
        "lease_token",
    )


@query(
    "dlv13_drain_candidates",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id, pipeline_id, destination_id, attempt_count, next_ms AS next_attempt_ms FROM d
    WHERE status IN ('PENDING', 'FAILED') AND next_ms <= {NOW_MS} - 60000 AND created_ms > {NOW_MS} - CAST(900 AS BIGINT) * 86400000
    ORDER BY next_ms, id LIMIT 500
    """,
)
def dlv13_drain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = delivery.drain_candidates(
        frames.deliveries(spark, sf_dir), NOW, grace_seconds=60, lookback_days=900, limit=500
    )
    return due.select(
        "id", "pipeline_id", "destination_id", "attempt_count", millis("next_attempt_at").alias("next_attempt_ms")
    )


@query(
    "dlv14_find_deliveries",
    f"WITH {DELIVERIES_SQL} SELECT id, event_id, destination_id, attempt_count FROM d WHERE pipeline_id = 'p1' AND dedupe_key = sha256('field:o_orderkey=1')",
)
def dlv14_find_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hashlib import sha256

    key = sha256(b"field:o_orderkey=1").hexdigest()
    found = delivery.find_deliveries(frames.deliveries(spark, sf_dir), "p1", key)
    return found.select("id", "event_id", "destination_id", "attempt_count")


@query(
    "agg6_count_by_status",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT pipeline_id, count(*) FILTER (status = 'PENDING') AS "PENDING", count(*) FILTER (status = 'IN_FLIGHT') AS "IN_FLIGHT",
           count(*) FILTER (status = 'DELIVERED') AS "DELIVERED", count(*) FILTER (status = 'FAILED') AS "FAILED",
           count(*) FILTER (status = 'DISCARDED') AS "DISCARDED"
    FROM d GROUP BY pipeline_id
    """,
)
def agg6_count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.count_by_status(frames.deliveries(spark, sf_dir))


@query(
    "agg7_stuck",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT pipeline_id, destination_id, status, count(*) AS n FROM d WHERE status IN ('FAILED', 'DISCARDED') GROUP BY ALL
    """,
)
def agg7_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stuck(frames.deliveries(spark, sf_dir))


@query(
    "agg8_counters_delivery",
    f"""
    WITH {DELIVERIES_SQL},
    a AS (
      SELECT pipeline_id, destination_id, owned, CASE WHEN kind = 'SUCCESS' THEN 'ok' WHEN next_status = 'DISCARDED' THEN 'dead' ELSE 'retry' END AS outcome,
             CASE WHEN kind = 'SUCCESS' THEN NULL WHEN kind = 'RETRYABLE' AND next_status = 'DISCARDED' THEN 'ATTEMPTS_EXHAUSTED' ELSE why END AS reason FROM routed WHERE lease_s IS NOT NULL
    )
    SELECT 'gateway.deliveries' AS metric, pipeline_id, destination_id, outcome, reason, count(*) AS value FROM a GROUP BY ALL
    UNION ALL
    SELECT 'gateway.delivery.duplicate_detected', pipeline_id, destination_id, NULL, NULL, count(*) FROM a WHERE outcome = 'ok' AND NOT owned GROUP BY ALL
    """,
)
def agg8_counters_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = audit.metrics_counters(attempts=_attempts(spark, sf_dir))
    return counted.select("metric", "pipeline_id", "destination_id", "outcome", "reason", "value")


@query(
    "agg9_duration_histogram",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT pipeline_id, destination_id, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS total, min(duration_ms) AS low, max(duration_ms) AS high,
           count(*) FILTER (duration_ms <= 100) AS le_100, count(*) FILTER (duration_ms > 100 AND duration_ms <= 500) AS le_500, count(*) FILTER (duration_ms > 500) AS le_inf
    FROM routed WHERE lease_s IS NOT NULL GROUP BY ALL
    """,
)
def agg9_duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _attempts(spark, sf_dir)
    return audit.metrics_histograms(attempts, "duration_ms", ["pipeline_id", "destination_id"], [100, 500])
