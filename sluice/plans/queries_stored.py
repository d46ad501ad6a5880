"""Queries over tables that jobs keep: written to the shared folder, read back, compared with SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import audit, delivery
from sluice.operators.keys import with_dedupe_key
from sluice.operators.retention import policy_frame
from sluice.plans import frames
from sluice.plans.deliver import CycleLimits, add_deliveries, delivery_store, run_cycle
from sluice.plans.frames import DELIVERY_NOW, millis
from sluice.plans.metrics import RANK_ERROR, add_counters, counter_table, hourly_sketches, poll_durations, quantiles, sketch_table
from sluice.plans.queries_delivery import DELIVERIES_SQL, NOW_MS
from sluice.plans.queries_intake import PAGES_SQL, RUN_ID, sql_uuid7
from sluice.plans.registry import query
from sluice.plans.retain import drop_expired_deliveries, purge_events
from sluice.plans.run import run_batch
from sluice.sinks.keyed import KeyedTable
from sluice.sinks.ledger import Ledger, append_events, events_of, open_ledger
from sluice.sources.pages import page_documents
from sluice.spec import DedupeSpec
from sluice.streaming.dedupe import dedupe_stream
from sluice.streaming.delivery import delivery_state_stream
from sluice.streaming.intake import run_stream

SECOND = DELIVERY_NOW + timedelta(days=1)
SECOND_MS = NOW_MS + 86_400_000
LIMITS = CycleLimits(lookback_days=3_650, reap=1_000_000, claim=1_000_000)


def _cycle_sql(k: int, now: int, owned: str, wait: str) -> str:
    """One cycle over state s{k - 1}: results, reaper, reconciliation, claim, rendering."""
    recent = f"created_ms > {now} - CAST({LIMITS.lookback_days} AS BIGINT) * 86400000"
    return f"""
    o{k} AS (
      SELECT s.*, kind, why, net_code, {wait} AS wait2, expo, initial_ms, lease_s, coalesce({owned}, false) AS owned,
             CASE WHEN kind = 'SUCCESS' THEN 'DELIVERED' WHEN kind = 'NON_RETRYABLE' OR attempt_count >= 3 THEN 'DISCARDED' ELSE 'FAILED' END AS nxt
      FROM s{k - 1} s JOIN (SELECT n, kind, why, net_code, expo, initial_ms, lease_s FROM j) USING (n)
    ),
    a{k} AS (
      SELECT * REPLACE (
        CASE WHEN owned THEN nxt ELSE status END AS status,
        CASE WHEN owned AND nxt = 'DISCARDED' THEN CASE kind WHEN 'NON_RETRYABLE' THEN 'NON_RETRYABLE_STATUS' ELSE 'ATTEMPTS_EXHAUSTED' END ELSE discard_reason END AS discard_reason,
        CASE WHEN NOT owned THEN error_code WHEN nxt = 'DISCARDED' THEN why WHEN nxt = 'FAILED' THEN net_code END AS error_code,
        CASE WHEN owned AND nxt = 'FAILED' THEN {now} + CASE WHEN wait2 IS NOT NULL THEN least(wait2, 3600000)
          WHEN expo THEN CAST(initial_ms * power(2, greatest(attempt_count - 1, 0)) AS BIGINT) ELSE initial_ms END ELSE next_ms END AS next_ms,
        CASE WHEN owned AND nxt = 'DELIVERED' THEN {now} ELSE delivered_ms END AS delivered_ms,
        CASE WHEN NOT owned THEN lease_ms END AS lease_ms) FROM o{k}
    ),
    b{k} AS (SELECT *, coalesce(status = 'IN_FLIGHT' AND lease_ms < {now} AND {recent}, false) AS reaped FROM a{k}),
    c{k} AS (
      SELECT * REPLACE (
        CASE WHEN NOT reaped THEN status WHEN attempt_count >= 3 THEN 'DISCARDED' ELSE 'FAILED' END AS status,
        CASE WHEN NOT reaped THEN discard_reason WHEN attempt_count >= 3 THEN 'ATTEMPTS_EXHAUSTED' END AS discard_reason,
        CASE WHEN reaped THEN coalesce(error_code, 'LEASE_EXPIRED') ELSE error_code END AS error_code,
        CASE WHEN reaped THEN {now} ELSE next_ms END AS next_ms, CASE WHEN NOT reaped THEN lease_ms END AS lease_ms) FROM b{k}
    ),
    e{k} AS (SELECT *, status IN ('PENDING', 'FAILED', 'IN_FLIGHT') AND pipeline_id <> 'p2' AND lease_s IS NULL AS removed FROM c{k}),
    f{k} AS (
      SELECT * REPLACE (CASE WHEN removed THEN 'DISCARDED' ELSE status END AS status, CASE WHEN removed THEN 'DESTINATION_REMOVED' ELSE discard_reason END AS discard_reason,
                        CASE WHEN NOT removed THEN lease_ms END AS lease_ms) FROM e{k}
    ),
    g{k} AS (
      SELECT *, status IN ('PENDING', 'FAILED') AND next_ms <= {now} AND {recent} AND attempt_count < 3 AND lease_s IS NOT NULL AS taken,
             created_at < TIMESTAMP '1995-06-01' AS gone, n % 10 = 9 AS odd FROM f{k}
    ),
    s{k} AS (
      SELECT n, id, created_at, created_ms, pipeline_id, attempt_count + CASE WHEN taken THEN 1 ELSE 0 END AS attempt_count,
             CASE WHEN NOT taken THEN status WHEN gone OR odd THEN 'DISCARDED' ELSE 'IN_FLIGHT' END AS status,
             CASE WHEN taken AND (gone OR odd) THEN 'INVALID_PAYLOAD' ELSE discard_reason END AS discard_reason,
             CASE WHEN taken AND gone THEN 'EVENT_NOT_FOUND' WHEN taken AND odd THEN 'TRANSFORM_FAILED' ELSE error_code END AS error_code,
             next_ms, delivered_ms, CASE WHEN NOT taken THEN lease_ms WHEN NOT (gone OR odd) THEN {now} + lease_s * 1000 END AS lease_ms,
             taken AND NOT (gone OR odd) AS sent
      FROM g{k}
    )"""


def _store_after_cycles(spark: SparkSession, sf_dir: str, name: str) -> tuple[KeyedTable, DataFrame]:
    """All orders as deliveries, one cycle with the known results, a second with the results of what the first sent."""
    flows = frames.delivery_flows()
    store = delivery_store(spark, frames.work_folder(spark, name), fan=3)
    add_deliveries(store, frames.deliveries(spark, sf_dir), "orders")
    events, results = frames.stored_events(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir)
    sent = run_cycle(store, events, flows, "first", DELIVERY_NOW, "w1", results, LIMITS)
    token = sent.select("delivery_id", F.col("lease_token").alias("_token"))
    lost = F.col("lease_token").startswith("x")
    answers = results.join(token, "delivery_id").withColumn("lease_token", F.when(lost, F.col("lease_token")).otherwise(F.col("_token"))).drop("_token")
    return store, run_cycle(store, events, flows, "second", SECOND, "w1", answers, LIMITS)


_CYCLES = f"""
WITH {DELIVERIES_SQL},
s0 AS (SELECT n, id, created_at, created_ms, pipeline_id, attempt_count, status, CAST(NULL AS VARCHAR) AS discard_reason, error_code, next_ms,
              CAST(NULL AS BIGINT) AS delivered_ms, lease_ms, false AS sent FROM d),
{_cycle_sql(1, NOW_MS, "s.status = 'IN_FLIGHT' AND s.n % 13 <> 0 AND lease_s IS NOT NULL", "CASE WHEN net_code IS NULL THEN CASE s.n % 4 WHEN 0 THEN 120000 WHEN 1 THEN 600000 END END")},
{_cycle_sql(2, SECOND_MS, "s.sent AND s.n % 13 <> 0", "CASE WHEN net_code IS NULL THEN CASE s.n % 4 WHEN 0 THEN 120000 WHEN 1 THEN 0 END END")}
"""


@query(
    "snk2_dlv_stored_cycles",
    _CYCLES
    + """
    SELECT id, strftime(created_at, '%Y%m') AS created_month, CASE WHEN status IN ('DELIVERED', 'DISCARDED') THEN 'closed' ELSE 'open' END AS state,
           status, attempt_count, discard_reason, error_code, next_ms AS next_attempt_ms, delivered_ms, lease_ms AS lease_expires_ms FROM s2
    """,
)
def snk2_dlv_stored_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _store_after_cycles(spark, sf_dir, "cycles")
    return store.read().select(
        "id",
        "created_month",
        "state",
        "status",
        "attempt_count",
        "discard_reason",
        "error_code",
        millis("next_attempt_at").alias("next_attempt_ms"),
        millis("delivered_at").alias("delivered_ms"),
        millis("lease_expires_at").alias("lease_expires_ms"),
    )


@query(
    "trf7_requests_of_second_cycle",
    _CYCLES
    + """
    SELECT id AS delivery_id, CAST(attempt_count AS VARCHAR) AS attempt,
           '{"cliente":' || o_custkey || ',"estado":"' || lower(o_orderstatus) || '","pedido":"' || n || '","prioridade":{"nivel":' || substr(o_orderpriority, 1, 1) || '}}' AS body
    FROM s2 JOIN (SELECT n, o_custkey, o_orderstatus, o_orderpriority FROM d) USING (n) WHERE sent
    """,
)
def trf7_requests_of_second_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sent = _store_after_cycles(spark, sf_dir, "requests")
    return sent.select("delivery_id", F.col("headers")["x-delivery-attempt"].alias("attempt"), "body")


# --- the event ledger over several batches -----------------------------------

BATCHES = 4


def _ledger_after_batches(spark: SparkSession, sf_dir: str, name: str) -> Ledger:
    """All landed pages in four batches (cycles by turns), merged in pairs on the way; the last batch is repeated."""
    spec, pages = frames.poll_flow(), frames.landed_pages(spark, sf_dir)
    folder = frames.work_folder(spark, name)
    ledger = open_ledger(spark, Ledger(folder, f"q_{folder[-32:]}", buckets=8, fan=2))
    for batch in [*range(BATCHES), BATCHES - 1]:
        mine = pages.filter(F.col("cycle_id") % BATCHES == batch)
        run_batch(page_documents(mine, spec), spec, ledger, f"b{batch}", frames.NOW)
    return ledger


_BATCHED = f"""
WITH {PAGES_SQL},
keyed AS (
  SELECT *, sha256(src) AS key, row_number() OVER w AS nth, first_value(ms) OVER w AS first_ms FROM it WHERE keep
  WINDOW w AS (PARTITION BY src ORDER BY cycle % {BATCHES}, ms, idx)
)
"""


@query(
    "snk1_stored_events",
    _BATCHED
    + f"""
    SELECT {sql_uuid7("ms", "'coleta|' || key")} AS id, ms AS created_ms, key AS dedupe_key, src AS dedupe_source, {RUN_ID} AS run_id
    FROM keyed WHERE nth = 1
    """,
)
def snk1_stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger_after_batches(spark, sf_dir, "events")
    return events_of(spark, ledger).select("id", millis("created_at").alias("created_ms"), "dedupe_key", "dedupe_source", "run_id")


@query(
    "snk3_stored_runs",
    _BATCHED
    + f"""
    SELECT {RUN_ID} AS id, page AS request_page, ms AS created_ms, 'POLL' AS trigger,
           CASE WHEN error_code IS NULL THEN 'SUCCESS' ELSE 'ERROR' END AS status,
           (SELECT count(*) FROM it WHERE it.cycle = pg.cycle AND it.page = pg.page) AS items_received,
           (SELECT count(*) FROM it WHERE it.cycle = pg.cycle AND it.page = pg.page AND NOT keep) AS items_filtered_out,
           (SELECT count(DISTINCT key) FROM keyed k WHERE k.cycle = pg.cycle AND k.page = pg.page AND k.first_ms <> k.ms) AS items_duplicate,
           (SELECT count(*) FROM keyed k WHERE k.cycle = pg.cycle AND k.page = pg.page AND nth = 1) AS items_new,
           'https://origin.example/itens' AS request_url, 1706745600000 AS finished_ms, 1706745600000 - ms AS duration_ms, error_code
    FROM pg
    """,
)
def snk3_stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger_after_batches(spark, sf_dir, "runs")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("items_received", "items_filtered_out", "items_duplicate", "items_new")]
    return spark.table(ledger.table("runs")).select(
        "id",
        F.col("request_page").cast("bigint").alias("request_page"),
        millis("created_at").alias("created_ms"),
        "trigger",
        "status",
        *counts,
        "request_url",
        millis("finished_at").alias("finished_ms"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"),
        "error_code",
    )


# --- the same from streams ----------------------------------------------------


def _landed(rows: DataFrame, folder: str) -> DataFrame:
    """Rows written to a landing folder, and the stream that reads it."""
    rows.write.parquet(f"{folder}/landing")
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/landing")


def _written(changes: DataFrame, folder: str) -> DataFrame:
    """Everything a stream gives for what has landed, as files."""
    writer = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return changes.sparkSession.read.schema(changes.schema).parquet(f"{folder}/out")


@query(
    "str1_streamed_events",
    f"""
    WITH {PAGES_SQL},
    keyed AS (SELECT *, sha256(src) AS key, row_number() OVER (PARTITION BY src ORDER BY ms, idx) AS nth FROM it WHERE keep)
    SELECT {sql_uuid7("ms", "'coleta|' || key")} AS id, ms AS created_ms, key AS dedupe_key, src AS dedupe_source, {RUN_ID} AS run_id
    FROM keyed WHERE nth = 1
    """,
)
def str1_streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages through the continuous intake into a ledger."""
    spec, folder = frames.poll_flow(), frames.work_folder(spark, "stream")
    ledger = Ledger(folder, f"q_{folder[-32:]}", buckets=8)
    source = _landed(frames.landed_pages(spark, sf_dir), folder)
    run_stream(source, spec, ledger, f"{folder}/checkpoint", clock=lambda: frames.NOW).awaitTermination()
    stored = events_of(spark, open_ledger(spark, ledger))
    return stored.select("id", millis("created_at").alias("created_ms"), "dedupe_key", "dedupe_source", "run_id")


@query(
    "str2_deduped_keys",
    "SELECT DISTINCT 'f' AS pipeline_id, sha256('field:code=' || user_id || '|field:type=' || event_type) AS dedupe_key FROM events",
)
def str2_deduped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all events through the dedupe that forgets (here within its time)."""
    spec, folder = DedupeSpec(fields=("code", "type")), frames.work_folder(spark, "deduped")
    items = _landed(frames.table(spark, sf_dir, "events"), folder).select(
        F.lit("f").alias("pipeline_id"), frames.utc("ts").alias("run_created_at"), F.parse_json(frames.item_json()).alias("item")
    )
    return _written(dedupe_stream(with_dedupe_key(items, spec), spec).select("pipeline_id", "dedupe_key"), folder)


# States the deliveries are dealt to: at 6 GB, with all results at once, under seven thousand deliveries in each.
SHARES = 4_096


@query(
    "str3_streamed_states",
    f"""
    WITH {DELIVERIES_SQL}
    SELECT id AS delivery_id, CASE kind WHEN 'SUCCESS' THEN 'DELIVERED' WHEN 'NON_RETRYABLE' THEN 'DISCARDED' ELSE 'FAILED' END AS status, 1 AS attempts
    FROM routed WHERE lease_s IS NOT NULL
    """,
)
def str3_streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first result of every delivery through the state stream."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folder = frames.work_folder(spark, "states")
    identity = frames.deliveries(spark, sf_dir).select(F.col("id").alias("delivery_id"), "pipeline_id", "destination_id", "max_attempts")
    results = frames.attempt_outcomes(spark, sf_dir).select("delivery_id", "finished_at", "net_code", "status", "headers")
    changes = delivery_state_stream(_landed(results.join(identity, "delivery_id"), folder), frames.delivery_flows(), shares=SHARES)
    found = _written(changes, folder).filter(F.col("status") != "DUE")
    return found.select("delivery_id", "status", "attempts")


# --- retention, counters, durations ------------------------------------------

PURGE_DAYS, PURGE_BATCH = 2_000, 3_000


@query(
    "ret1_ret3_applied",
    f"""
    WITH {DELIVERIES_SQL},
    stored AS (SELECT * FROM d WHERE created_at >= TIMESTAMP '1995-06-01'),
    old AS (SELECT id, event_id FROM stored WHERE created_ms < {NOW_MS} - CAST({PURGE_DAYS} AS BIGINT) * 86400000 ORDER BY created_ms, event_id LIMIT {PURGE_BATCH}),
    gone AS (SELECT old.event_id FROM old JOIN d USING (id) WHERE status IN ('DELIVERED', 'DISCARDED'))
    SELECT 'event' AS kind, event_id AS id FROM stored WHERE event_id NOT IN (SELECT event_id FROM gone)
    UNION ALL
    SELECT 'delivery', id FROM d WHERE created_at >= TIMESTAMP '2001-02-01'
    """,
)
def ret1_ret3_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of events and deliveries after a purge of old events and of expired months, each done twice over."""
    folder = frames.work_folder(spark, "retention")
    ledger = open_ledger(spark, Ledger(folder, f"q_{folder[-32:]}", buckets=8))
    events = frames.stored_events(spark, sf_dir)
    for batch in (0, 1):
        append_events(events.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == batch), ledger, f"b{batch}")
    store = delivery_store(spark, folder)
    add_deliveries(store, frames.deliveries(spark, sf_dir), "orders")
    purge_events(spark, ledger, store, DELIVERY_NOW, PURGE_DAYS, PURGE_BATCH)
    policy = policy_frame(spark)
    for _ in range(2):
        drop_expired_deliveries(store, policy, DELIVERY_NOW)
    left = events_of(spark, ledger).select(F.lit("event").alias("kind"), "id")
    return left.unionByName(store.read().select(F.lit("delivery").alias("kind"), "id"))


@query(
    "agg8_counters_kept",
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
def agg8_counters_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts in five batches, the last one twice: the kept totals are those of all attempts."""
    table = counter_table(spark, frames.work_folder(spark, "counters"), fan=2)
    attempts = delivery.attempt_results(
        frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir), DELIVERY_NOW, frames.delivery_flows()
    )
    for batch in (0, 1, 2, 3, 4, 4):
        mine = attempts.filter(F.substring("delivery_id", 2, 30).cast("bigint") % 5 == batch)
        add_counters(table, audit.metrics_counters(attempts=mine), f"b{batch}")
    return table.read().select("metric", "pipeline_id", "destination_id", "outcome", "reason", "value")


@query(
    "agg9_poll_duration_kept",
    f"""
    WITH {PAGES_SQL},
    cycle AS (SELECT cycle, max(ms) - min(ms) AS took FROM pg GROUP BY cycle)
    SELECT 'coleta' AS pipeline_id, count(*) AS n, true AS within_error FROM cycle
    """,
)
def agg9_poll_duration_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of all poll cycles as hourly sketches in three batches, merged upwards; compared with exact ranks."""
    durations = poll_durations(page_documents(frames.landed_pages(spark, sf_dir), frames.poll_flow()))
    table = sketch_table(spark, frames.work_folder(spark, "durations"), fan=2)
    for batch in range(3):
        mine = durations.filter(F.pmod(F.xxhash64("at"), F.lit(3)) == batch)
        table.upsert(f"b{batch}", hourly_sketches(mine, "poll_duration"))
        table.compact()
    found = quantiles(table.read(), ["pipeline_id"], (0.5, 0.9, 0.99))
    below = durations.join(F.broadcast(found), "pipeline_id").groupBy("pipeline_id", "n")
    inside = [
        (F.avg((F.col("value") < F.col(q)).cast("double")) <= F.lit(share + RANK_ERROR)) & (F.avg((F.col("value") <= F.col(q)).cast("double")) >= F.lit(share - RANK_ERROR))
        for q, share in (("q_50", 0.5), ("q_90", 0.9), ("q_99", 0.99))
    ]
    return below.agg((inside[0] & inside[1] & inside[2]).alias("within_error"))
