"""The delivery state machine as set-wise steps.

A step takes the current snapshot of deliveries and returns the next one. Only
open rows ever change, so the steps are meant for the open part of the table
(see `sluice.sinks.ledger`), which is a thousandth of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions import retry
from sluice.functions.dates import month_partition
from sluice.functions.ids import uuid7_of
from sluice.functions.redact import cut
from sluice.functions.reshape import apply_transform
from sluice.functions.variants import read_json
from sluice.operators.skew import spread_by_key, within_first
from sluice.operators.tables import DESTINATION_SCHEMA, destination_rows, keys_fit, spec_table
from sluice.spec import FlowSpec

# Column name and type of every delivery column, in table order.
DELIVERY_COLUMNS = {
    "id": "string",
    "created_at": "timestamp",
    "pipeline_id": "string",
    "destination_id": "string",
    "event_id": "string",
    "dedupe_key": "string",
    "status": "string",
    "attempt_count": "int",
    "max_attempts": "int",
    "next_attempt_at": "timestamp",
    "lease_token": "string",
    "lease_expires_at": "timestamp",
    "worker_id": "string",
    "request_method": "string",
    "request_url": "string",
    "request_body": "string",
    "request_body_bytes": "int",
    "request_body_sha256": "string",
    "response_status": "int",
    "response_body": "string",
    "response_headers": "map<string,string>",
    "error_code": "string",
    "error_message": "string",
    "discard_reason": "string",
    "first_attempt_at": "timestamp",
    "last_attempt_at": "timestamp",
    "delivered_at": "timestamp",
    "duration_ms": "int",
    "updated_at": "timestamp",
}
OUTCOME_COLUMNS = {
    "delivery_id": "string",
    "lease_token": "string",
    "finished_at": "timestamp",
    "net_code": "string",
    "net_message": "string",
    "status": "int",
    "headers": "map<string,string>",
    "body": "string",
    "request_body": "string",
    "duration_ms": "int",
}
# What of a result decides where its delivery goes.
_ROUTED_BY = ("delivery_id", "lease_token", "finished_at", "net_code", "status", "headers", "duration_ms")
OPEN = ("PENDING", "FAILED", "IN_FLIGHT")


def instant(now: datetime | Column) -> Column:
    return (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")


def as_deliveries(rows: DataFrame) -> DataFrame:
    """Rows with every delivery column, missing ones NULL; other columns are dropped."""
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
            for c, t in DELIVERY_COLUMNS.items()
        ]
    )


def as_outcomes(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
            for c, t in OUTCOME_COLUMNS.items()
        ]
    )


def with_destination(rows: DataFrame, specs: Sequence[FlowSpec], how: str = "left") -> DataFrame:
    table, small = spec_table(rows.sparkSession, destination_rows(specs), DESTINATION_SCHEMA)
    return rows.join(
        F.broadcast(table) if small else table, ["pipeline_id", "destination_id"], how
    )


def created_after(rows: DataFrame, bound: Column) -> DataFrame:
    """created_at > bound; the month partition, where there is one, is pruned too."""
    kept = rows.filter(F.col("created_at") > bound)
    if "created_month" in rows.columns:
        kept = kept.filter(F.col("created_month") >= month_partition(bound))
    return kept


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def _claimable(now: Column) -> Column:
    free = F.col("status").isin("PENDING", "FAILED") | (
        (F.col("status") == "IN_FLIGHT") & (F.col("lease_expires_at") < now)
    )
    return F.coalesce((F.col("attempt_count") < F.col("max_attempts")) & free, F.lit(False))


def claim(
    deliveries: DataFrame,
    now: datetime | Column,
    worker: str,
    specs: Sequence[FlowSpec],
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Next snapshot plus `claimed`.

    Claimable rows (of known destinations, and among `wanted.id` when given)
    become IN_FLIGHT; the attempt is counted here, before anything is sent. The
    lease lasts as long as the destination's timeout asks for.
    """
    now = instant(now)
    columns = deliveries.columns
    rows = with_destination(deliveries, specs)
    may = _claimable(now) & F.col("lease_seconds").isNotNull()
    if wanted is not None:
        asked = wanted.select("id").distinct().withColumn("_asked", F.lit(True))
        rows = rows.join(asked, "id", "left")
        may = may & F.coalesce(F.col("_asked"), F.lit(False))
    rows = rows.withColumn("claimed", may)
    token = uuid7_of(
        now, F.col("id"), (F.col("attempt_count") + 1).cast("string"), F.lit(worker)
    )
    until = F.timestamp_micros(F.unix_micros(now) + F.col("lease_seconds").cast("bigint") * 1_000_000)
    changed = {
        "status": F.lit("IN_FLIGHT"),
        "attempt_count": F.col("attempt_count") + 1,
        "lease_token": token,
        "lease_expires_at": until,
        "worker_id": F.lit(worker),
        "first_attempt_at": F.coalesce("first_attempt_at", now),
        "last_attempt_at": now,
        "updated_at": now,
    }
    return _changed(rows, columns, F.col("claimed"), changed, "claimed")


def _changed(
    rows: DataFrame, columns: Sequence[str], when: Column, changes: dict[str, Column], *extra: str
) -> DataFrame:
    """Apply `changes` to the rows where `when` holds; keep `columns` and `extra`."""
    return rows.select(
        *[
            F.when(when, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in columns
        ],
        *extra,
    )


def claim_miss(deliveries: DataFrame, requests: DataFrame, now: datetime | Column) -> DataFrame:
    """Why each requested delivery (id, created_at) cannot be claimed; NULL when it can."""
    now = instant(now)
    state = deliveries.select(
        "id", "created_at", "status", "attempt_count", "max_attempts", "lease_expires_at"
    )
    joined = requests.select("id", "created_at").join(state, ["id", "created_at"], "left")
    reason = (
        F.when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("status").isin("DELIVERED", "DISCARDED"), "ALREADY_TERMINAL")
        .when(F.col("attempt_count") >= F.col("max_attempts"), "ATTEMPTS_EXHAUSTED")
        .when(~_claimable(now), "LEASE_HELD_BY_OTHER")
    )
    return joined.select("id", "created_at", reason.alias("reason"))


def kept_body(body: Column, retention: Column, limit: int) -> Column:
    """FULL keeps it, TRUNCATED cuts it, HASH_ONLY drops it."""
    return F.when(retention == "FULL", body).when(retention == "TRUNCATED", cut(body, limit))


def retain_body(rows: DataFrame) -> DataFrame:
    """Apply `persist_body` to request and response; size and hash of the request stay."""
    retention = F.col("persist_body")
    return rows.withColumns(
        {
            "request_body_bytes": F.octet_length("request_body"),
            "request_body_sha256": F.sha2("request_body", 256),
            "request_body": kept_body(F.col("request_body"), retention, M.MAX_REQUEST_BODY),
            "response_body": kept_body(F.col("response_body"), retention, M.MAX_RESPONSE_BODY),
            "error_message": F.substring("error_message", 1, M.MAX_MESSAGE),
        }
    )


def _tie() -> Column:
    """Order of results of one lease that came in at the same instant."""
    return F.xxhash64("status", "net_code", "body")


def first_results(outcomes: DataFrame, leases: DataFrame | None = None) -> DataFrame:
    """One result per (delivery, lease), the first to come in, packed as `r`.

    Bodies are sorted with their keys once, and `spread_by_key` keeps a task's share of them small. Results of no lease in
    `leases` (delivery_id, lease_token), when given, go before the sort: the keys are hashed, the bodies only pass by.
    """
    keys = ["delivery_id", "lease_token"]
    spread = spread_by_key(outcomes, *keys)
    if leases is not None:
        spread = spread.join(leases.hint("shuffle_hash"), keys, "left_semi")
    return spread.groupBy(*keys).agg(F.min_by(F.struct(*outcomes.columns), F.struct("finished_at", _tie())).alias("r"))


def held_results(deliveries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The first result of each lease that a delivery still holds: delivery_id, lease_token and `r`."""
    leases = deliveries.filter(F.col("lease_token").isNotNull()).select(F.col("id").alias("delivery_id"), "lease_token")
    return first_results(as_outcomes(outcomes), leases)


def _routing(rows: DataFrame, now: Column, specs: Sequence[FlowSpec], in_turn: Column) -> DataFrame:
    """Classify `r` and decide what it does to its delivery.

    Adds `kind`, `why`, `next_status`, `delay_ms` and `owned`: the result came in turn
    and carries the lease the row has. A discard only asks for the token, the
    other outcomes for the state as well. A destination the specs do not know
    cannot be judged; its rows stay as they are.
    """
    r = F.col("r")
    rows = with_destination(rows, specs)
    verdict = retry.classify(r["net_code"], r["status"], F.col("success_statuses"))
    rows = rows.withColumn("_class", F.when(r.isNotNull() & F.col("lease_seconds").isNotNull(), verdict))
    kind = F.col("_class.kind")
    spent = F.col("attempt_count") >= F.col("max_attempts")
    next_status = (
        F.when(kind == retry.SUCCESS, "DELIVERED")
        .when((kind == retry.NON_RETRYABLE) | (spent & kind.isNotNull()), "DISCARDED")
        .when(kind.isNotNull(), "FAILED")
    )
    token_fits = F.col("lease_token") == r["lease_token"]
    owned = in_turn & token_fits & kind.isNotNull() & ((F.col("status") == "IN_FLIGHT") | (next_status == "DISCARDED"))
    delay = retry.backoff_ms(
        F.col("attempt_count"),
        F.col("retry_initial_ms"),
        F.col("retry_max_ms"),
        F.col("retry_factor"),
        F.col("retry_jitter"),
        F.col("retry_exponential"),
        retry.retry_after_ms(r["headers"]["retry-after"], now),
        retry.unit_draw(F.col("id"), F.col("attempt_count").cast("string")),
    )
    return rows.withColumns(
        {
            "kind": kind,
            "why": F.col("_class.why"),
            "next_status": next_status,
            "owned": F.coalesce(owned, F.lit(False)),
            "delay_ms": F.when(next_status == "FAILED", delay),
        }
    ).drop("_class")


def apply_outcomes(
    deliveries: DataFrame, outcomes: DataFrame, now: datetime | Column, specs: Sequence[FlowSpec]
) -> DataFrame:
    """Next snapshot after attempt results: DELIVERED, FAILED with a next attempt, or DISCARDED.

    Only the first result carrying the row's own lease token changes it, so the
    join on id and token meets at most one result per delivery.
    """
    return apply_results(deliveries, held_results(deliveries, outcomes), now, specs)


def apply_results(
    deliveries: DataFrame, results: DataFrame, now: datetime | Column, specs: Sequence[FlowSpec]
) -> DataFrame:
    """`apply_outcomes` with the rows of `held_results`, which a caller may have written."""
    now = instant(now)
    results = results.withColumnRenamed("lease_token", "_token")
    fits = (F.col("id") == F.col("delivery_id")) & (F.col("lease_token") == F.col("_token"))
    rows = _routing(deliveries.join(results, fits, "left"), now, specs, F.lit(True))
    retention = F.col("persist_body")
    network = F.col("r.net_code").isNotNull()
    request = F.col("r.request_body")
    delivered = F.col("next_status") == "DELIVERED"
    discarded = F.col("next_status") == "DISCARDED"
    failed = F.col("next_status") == "FAILED"
    null = F.lit(None)
    changes = {
        "status": F.col("next_status"),
        "discard_reason": F.when(
            discarded & (F.col("kind") == retry.NON_RETRYABLE), "NON_RETRYABLE_STATUS"
        )
        .when(discarded, "ATTEMPTS_EXHAUSTED")
        .otherwise(F.col("discard_reason")),
        "delivered_at": F.when(delivered, now).otherwise(F.col("delivered_at")),
        "next_attempt_at": F.when(
            failed, F.timestamp_micros(F.unix_micros(now) + F.col("delay_ms") * 1_000)
        ).otherwise(F.col("next_attempt_at")),
        "error_code": F.when(discarded, F.col("why")).when(failed, F.col("r.net_code")),
        "error_message": F.when(
            ~delivered & network, F.substring("r.net_message", 1, M.MAX_MESSAGE)
        ),
        "response_status": F.when(~network, F.col("r.status")),
        "response_body": F.when(
            ~network, kept_body(F.col("r.body"), retention, M.MAX_RESPONSE_BODY)
        ),
        "response_headers": F.when(~network, F.col("r.headers")),
        "request_body": kept_body(request, retention, M.MAX_REQUEST_BODY),
        "request_body_bytes": F.octet_length(request),
        "request_body_sha256": F.sha2(request, 256),
        "duration_ms": F.col("r.duration_ms"),
        "lease_token": null,
        "lease_expires_at": null,
        "updated_at": now,
    }
    return _changed(rows, deliveries.columns, F.col("owned"), changes)


def attempt_results(
    deliveries: DataFrame, outcomes: DataFrame, now: datetime | Column, specs: Sequence[FlowSpec]
) -> DataFrame:
    """Every reported result with its routing: `outcome` ok | dead | retry, `reason`, `owned`.

    Of several results for one lease only the first can own the row.
    """
    # bodies are not asked for here: what orders the results is taken from them before anything is shuffled
    asked = as_outcomes(outcomes).select(*_ROUTED_BY, _tie().alias("_tie"))
    results = within_first(
        asked,
        group=[F.col("delivery_id"), F.col("lease_token")],
        order=[F.col("finished_at"), F.col("_tie")],
        limit=1,
        salt_by=F.struct("finished_at", "status", "net_code", "duration_ms"),
        name="_turn",
    )
    packed = results.select(
        F.col("delivery_id").alias("id"), "_turn", F.struct(*_ROUTED_BY[1:]).alias("r")
    )
    state = deliveries.select(
        "id",
        "pipeline_id",
        "destination_id",
        "status",
        "attempt_count",
        "max_attempts",
        "lease_token",
    )
    rows = _routing(packed.join(state, "id"), instant(now), specs, F.col("_turn"))
    retryable = F.col("kind") == retry.RETRYABLE
    spent = F.col("next_status") == "DISCARDED"
    return rows.filter(F.col("kind").isNotNull()).select(
        F.col("id").alias("delivery_id"),
        F.col("r.lease_token").alias("lease_token"),
        "pipeline_id",
        "destination_id",
        F.when(F.col("kind") == retry.SUCCESS, "ok")
        .when(spent, "dead")
        .otherwise("retry")
        .alias("outcome"),
        F.when(retryable & spent, F.lit("ATTEMPTS_EXHAUSTED")).otherwise(F.col("why")).alias("reason"),
        F.col("r.status").alias("http_status"),
        F.col("r.duration_ms").alias("duration_ms"),
        "owned",
        "delay_ms",
    )


def duplicate_detected(
    deliveries: DataFrame, outcomes: DataFrame, now: datetime | Column, specs: Sequence[FlowSpec]
) -> DataFrame:
    """Successful results whose lease no longer owned the row: the destination got it twice."""
    results = attempt_results(deliveries, outcomes, now, specs)
    return results.filter((F.col("outcome") == "ok") & ~F.col("owned"))


def reconcile_spec(
    deliveries: DataFrame, specs: Sequence[FlowSpec], now: datetime | Column
) -> DataFrame:
    """Next snapshot plus `action`.

    discard: an open delivery whose destination was removed from a known flow.
    wait: the flow itself is unknown here; the row is left alone, retry in 60 s.
    """
    now = instant(now)
    flows = [s.id for s in specs]
    known_flow = F.col("pipeline_id").isin(*flows) if flows else F.lit(False)
    rows = with_destination(deliveries, specs)
    open_row = F.col("status").isin(*OPEN)
    action = F.when(open_row & ~known_flow, "wait").when(
        open_row & F.col("spec_url").isNull(), "discard"
    )
    rows = rows.withColumn("action", action)
    changes = {
        "status": F.lit("DISCARDED"),
        "discard_reason": F.lit("DESTINATION_REMOVED"),
        "lease_token": F.lit(None),
        "lease_expires_at": F.lit(None),
        "updated_at": now,
    }
    return _changed(rows, deliveries.columns, F.coalesce(action == "discard", F.lit(False)), changes, "action")


def render_requests(
    deliveries: DataFrame, events: DataFrame, specs: Sequence[FlowSpec]
) -> DataFrame:
    """Requests to send for claimed deliveries, rendered from the stored payload now.

    A row with `err_reason` set has no body: its event is gone (EVENT_NOT_FOUND) or
    a cast failed (TRANSFORM_FAILED). Flows are told apart inside one pass.
    """
    wanted = deliveries.filter(F.col("pipeline_id").isin(*[s.id for s in specs]))
    wanted = with_destination(wanted, specs, "inner")
    stored = events.select(
        F.col("id").alias("event_id"), "pipeline_id", "dedupe_key", F.col("payload").alias("_payload")
    )
    joined = wanted.join(stored, ["pipeline_id", "dedupe_key", "event_id"], "left")
    shown = joined.withColumn("_doc", read_json(F.col("_payload")))
    for spec in specs:
        # a flow's own document is NULL in the rows of the others: nothing is read twice
        own = F.when(F.col("pipeline_id") == spec.id, F.col("_doc"))
        shown = apply_transform(
            shown.withColumn("_own", own), spec.transform_rules, "_own", "_own_body", "_own_problem"
        )
        is_flow = F.col("pipeline_id") == spec.id
        earlier = "_body" in shown.columns
        shown = shown.withColumns(
            {
                "_body": F.when(is_flow, F.col("_own_body")).otherwise(F.col("_body") if earlier else None),
                "_problem": F.when(is_flow, F.col("_own_problem")).otherwise(
                    F.col("_problem") if earlier else None
                ),
            }
        ).drop("_own", "_own_body", "_own_problem")
    gone = F.col("_payload").isNull()
    headers = F.map_zip_with(
        F.create_map(
            F.lit("content-type"),
            F.lit("application/json"),
            F.lit("accept"),
            F.lit("application/json"),
            F.lit("idempotency-key"),
            F.col("id"),
            F.lit("x-event-id"),
            F.col("event_id"),
            F.lit("x-delivery-attempt"),
            F.col("attempt_count").cast("string"),
        ),
        F.col("spec_headers"),
        lambda _, ours, theirs: F.coalesce(theirs, ours),
    )
    return shown.select(
        F.col("id").alias("delivery_id"),
        "created_at",
        "pipeline_id",
        "destination_id",
        "event_id",
        "lease_token",
        F.col("spec_method").alias("method"),
        F.col("spec_url").alias("url"),
        headers.alias("headers"),
        F.when(~gone, F.col("_body")).alias("body"),
        F.when(gone, M.EVENT_NOT_FOUND)
        .when(F.col("_problem").isNotNull(), M.TRANSFORM_FAILED)
        .alias("err_reason"),
        F.when(gone, M.EVENT_PURGED).otherwise(F.col("_problem")).alias("err_detail"),
    )


def discard_invalid(
    deliveries: DataFrame, rendered: DataFrame, now: datetime | Column
) -> DataFrame:
    """Next snapshot: deliveries that could not be rendered end as INVALID_PAYLOAD."""
    now = instant(now)
    bad = rendered.filter(F.col("err_reason").isNotNull()).select(
        F.col("delivery_id").alias("id"),
        F.col("lease_token").alias("_token"),
        "err_reason",
        "err_detail",
    )
    rows = deliveries.join(bad, "id", "left")
    hit = F.col("err_reason").isNotNull() & F.col("lease_token").eqNullSafe(F.col("_token"))
    null = F.lit(None)
    changes = {
        "status": F.lit("DISCARDED"),
        "discard_reason": F.lit("INVALID_PAYLOAD"),
        "error_code": F.col("err_reason"),
        "error_message": F.substring("err_detail", 1, M.MAX_MESSAGE),
        "duration_ms": F.lit(0),
        "response_status": null,
        "response_body": null,
        "response_headers": null,
        "request_body": null,
        "request_body_bytes": null,
        "request_body_sha256": null,
        "lease_token": null,
        "lease_expires_at": null,
        "updated_at": now,
    }
    return _changed(rows, deliveries.columns, hit, changes)


def expired_leases(
    deliveries: DataFrame, now: datetime | Column, lookback_days: int, limit: int
) -> DataFrame:
    """The `limit` longest-expired leases inside the lookback."""
    now = instant(now)
    expired = created_after(
        deliveries.filter((F.col("status") == "IN_FLIGHT") & (F.col("lease_expires_at") < now)),
        now - _days(lookback_days),
    )
    return expired.orderBy("lease_expires_at", "id").limit(limit)


def reap(
    deliveries: DataFrame, now: datetime | Column, lookback_days: int, limit: int
) -> DataFrame:
    """Next snapshot plus `reaped`: expired leases become FAILED, or DISCARDED when spent.

    The reaped set has at most `limit` rows, which decides whether it is broadcast.
    """
    columns = deliveries.columns
    orphans = expired_leases(deliveries, now, lookback_days, limit).select("id").withColumn("_orphan", F.lit(True))
    if keys_fit(limit):
        orphans = F.broadcast(orphans)
    now = instant(now)
    rows = deliveries.join(orphans, "id", "left").withColumn(
        "reaped", F.coalesce(F.col("_orphan"), F.lit(False))
    )
    spent = F.col("attempt_count") >= F.col("max_attempts")
    changes = {
        "status": F.when(spent, "DISCARDED").otherwise("FAILED"),
        "discard_reason": F.when(spent, "ATTEMPTS_EXHAUSTED"),
        "error_code": F.coalesce("error_code", F.lit(M.LEASE_EXPIRED)),
        "error_message": F.coalesce("error_message", F.lit(M.LEASE_LOST)),
        "next_attempt_at": now,
        "lease_token": F.lit(None),
        "lease_expires_at": F.lit(None),
        "updated_at": now,
    }
    return _changed(rows, columns, F.col("reaped"), changes, "reaped")


def drain_candidates(
    deliveries: DataFrame,
    now: datetime | Column,
    grace_seconds: int,
    lookback_days: int,
    limit: int,
) -> DataFrame:
    """Overdue deliveries to hand out again, the longest overdue first."""
    now = instant(now)
    due = deliveries.filter(
        F.col("status").isin("PENDING", "FAILED")
        & (F.col("next_attempt_at") <= now - F.expr(f"INTERVAL {int(grace_seconds)} SECONDS"))
    )
    recent = created_after(due, now - _days(lookback_days))
    return (
        recent.orderBy("next_attempt_at", "id")
        .limit(limit)
        .select(
            "id",
            "created_at",
            "pipeline_id",
            "destination_id",
            "max_attempts",
            "attempt_count",
            "next_attempt_at",
        )
    )


def find_deliveries(deliveries: DataFrame, pipeline_id: str, dedupe_key: str) -> DataFrame:
    """Deliveries of one item; both conditions are pushed to the scan, no join."""
    return deliveries.filter(
        (F.col("pipeline_id") == pipeline_id) & (F.col("dedupe_key") == dedupe_key)
    ).select(
        "id",
        "created_at",
        "pipeline_id",
        "destination_id",
        "event_id",
        "attempt_count",
        "max_attempts",
    )
