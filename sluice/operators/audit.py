"""Item outcomes, run rows, responses, counters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.dedupe import KEY, RUN_ORDER
from sluice.operators.skew import attach_by_key
from sluice.spec import FlowSpec, PollSource

RUN = ("pipeline_id", "ingest_id", "run_id", "run_created_at", "page")
STATUSES = ("PENDING", "IN_FLIGHT", "DELIVERED", "FAILED", "DISCARDED")


def item_outcomes(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Outcome of every entry: accepted, duplicate, filtered, rejected or a marker state.

    All items of the run that brought a new key are accepted under one event id;
    `is_first` marks the one that became the event.
    """
    info = resolved.select(
        *KEY,
        "n_items",
        "is_new",
        "event_id",
        F.col("first.run_id").alias("_run"),
        F.col("first.idx").alias("_idx"),
        F.size("routes").alias("n_routes"),
    )
    slim = entries.select(
        *RUN,
        "http_status",
        "total_record_count",
        "error_code",
        "error_message",
        "idx",
        "state",
        "reason",
        "detail",
        "dedupe_key",
    )
    joined = attach_by_key(slim, info, KEY, ("run_id", "idx"))
    same_run = F.col("is_new") & (F.col("run_id") == F.col("_run"))
    is_first = F.coalesce(same_run & (F.col("idx") == F.col("_idx")), F.lit(False))
    status = (
        F.when(F.col("state") != "keyed", F.col("state"))
        .when(same_run, "accepted")
        .otherwise("duplicate")
    )
    return joined.select(
        *[c for c in slim.columns if c != "state"],
        status.alias("status"),
        "event_id",
        is_first.alias("is_first"),
        F.when(is_first, F.col("n_routes")).otherwise(0).alias("n_deliveries"),
    )


def _is(*states: str) -> Column:
    return F.col("status").isin(*states)


def run_counts(outcomes: DataFrame) -> DataFrame:
    """One row per run. Duplicates and new items count keys, the rest counts items.

    What a run says of itself is the same on all its rows and so part of the key.
    Duplicate keys are counted by grouping on them first, so only numbers are aggregated.
    """
    of_run = (*RUN, "http_status", "total_record_count", "error_code", "error_message")
    counts = {
        "items_received": F.count_if(_is("accepted", "duplicate", "filtered", "rejected")),
        "items_filtered_out": F.count_if(_is("filtered")),
        "items_new": F.count_if("is_first"),
        "deliveries_created": F.sum("n_deliveries"),
        "items_rejected": F.count_if(_is("rejected", "unsplit")),
        "items_keyed": F.count_if(_is("accepted", "duplicate")),
    }
    by_key = (
        outcomes.groupBy(*of_run, F.when(_is("duplicate"), F.col("dedupe_key")).alias("_key"))
        .agg(*(c.alias(name) for name, c in counts.items()))
        .groupBy(*of_run)
        .agg(F.count("_key").alias("items_duplicate"), *(F.sum(name).alias(name) for name in counts))
    )
    return by_key.select(*of_run, "items_received", "items_filtered_out", "items_duplicate", *list(counts)[2:])


def run_counts_of_entries(entries: DataFrame, ledger: DataFrame, route_on: str = "last") -> DataFrame:
    """The rows of `run_counts`, from the entries of an intake and the stored events.

    Items are counted per (run, key) first: what meets the ledger and comes back is one
    row per run and key, not one per item, and bodies are read for it once.
    """
    of_run = (*RUN, "http_status", "total_record_count", "error_code", "error_message")
    by_index = F.col("idx") if route_on == "last" else -F.col("idx")
    n_routes = F.max_by(F.coalesce(F.size("routes"), F.lit(0)), by_index)
    per_key = entries.groupBy(*of_run, "state", "dedupe_key").agg(F.count(F.lit(1)).alias("n"), n_routes.alias("n_routes"))
    # All of a row is asked for here and no row is left out (those without a key find no partner), so that both uses of
    # the counts are one exchange.
    first = F.min_by(F.struct("run_id", "state", "n", "n_routes", *of_run[-4:]), F.struct(*RUN_ORDER))
    firsts = per_key.groupBy(*KEY).agg(first.alias("_first"))
    seen = ledger.select(*KEY, F.lit(True).alias("_seen"))
    resolved = firsts.join(seen, list(KEY), "left").select(*KEY, F.when(F.col("_seen").isNull(), F.col("_first")).alias("_new"))
    rows = per_key.join(resolved, list(KEY), "left")
    keyed = F.col("state") == "keyed"
    new = F.coalesce(keyed & (F.col("_new.run_id") == F.col("run_id")), F.lit(False))

    def items(*states: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("state").isin(*states), F.col("n"))), F.lit(0))

    return rows.groupBy(*of_run).agg(
        items("keyed", "filtered", "rejected").alias("items_received"),
        items("filtered").alias("items_filtered_out"),
        F.count_if(keyed & ~new).alias("items_duplicate"),
        F.count_if(new).alias("items_new"),
        F.coalesce(F.sum(F.when(new, F.col("n_routes"))), F.lit(0)).alias("deliveries_created"),
        items("rejected", "unsplit").alias("items_rejected"),
        items("keyed").alias("items_keyed"),
    )


def run_status(counts: DataFrame) -> DataFrame:
    """Add `status` to run rows.

    A run in which no item got a key is PARTIAL when anything was rejected so far
    in its ingest, earlier pages included. The window holds one row per page.
    """
    so_far = (
        Window.partitionBy("pipeline_id", "ingest_id")
        .orderBy("page", "run_created_at", "run_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rejected = F.sum("items_rejected").over(so_far)
    status = (
        F.when(F.col("error_code").isNotNull(), "ERROR")
        .when((F.col("items_keyed") == 0) & (rejected > 0), "PARTIAL")
        .otherwise("SUCCESS")
    )
    return counts.withColumn("status", status)


def run_facts(entries: DataFrame) -> DataFrame:
    """What each run says of its input (`about` of its documents), one row per run."""
    return entries.groupBy("run_id").agg(F.max("about").alias("about"))


def run_rows(
    outcomes: DataFrame, trigger: str, facts: DataFrame | None = None, finished: datetime | Column | None = None
) -> DataFrame:
    """The audit rows of a batch of runs, in the column order of the run table.

    With `facts` (see `run_facts`) and the instant the batch was finished they also
    tell URL, type, size, address, trace, end and duration. The duration is what the
    source measured, else the time from the run's start to the end of its batch.
    """
    return run_rows_of_counts(run_counts(outcomes), trigger, facts, finished)


def run_rows_of_counts(
    counts: DataFrame, trigger: str, facts: DataFrame | None = None, finished: datetime | Column | None = None
) -> DataFrame:
    """The same from counts per run."""
    runs = run_status(counts)
    about = []
    if facts is not None:
        runs = runs.join(facts, "run_id", "left")
        end = (finished if isinstance(finished, Column) else F.lit(finished)).cast("timestamp")
        waited = (F.unix_millis(end) - F.unix_millis("run_created_at")).cast("int")
        about = [
            *[F.col(f"about.{c}").alias(c) for c in ("request_url", "content_type", "body_bytes", "source_ip")],
            F.coalesce("about.elapsed_ms", waited).alias("duration_ms"),
            end.alias("finished_at"),
            F.col("about.trace_id").alias("trace_id"),
        ]
    return runs.select(
        F.col("run_id").alias("id"),
        F.col("run_created_at").alias("created_at"),
        "pipeline_id",
        F.col("ingest_id").alias("run_group_id"),
        F.lit(trigger).alias("trigger"),
        "status",
        F.col("page").alias("request_page"),
        "http_status",
        "total_record_count",
        *[
            F.col(c).cast("int").alias(c)
            for c in (
                "items_received",
                "items_filtered_out",
                "items_duplicate",
                "items_new",
                "deliveries_created",
            )
        ],
        "error_code",
        F.substring("error_message", 1, 2_000).alias("error_message"),
        *about,
    )


def ingest_result(counts: DataFrame) -> DataFrame:
    """Totals over the runs of each ingest; failed pages add nothing."""
    done = counts.filter(F.col("error_code").isNull())
    return done.groupBy("pipeline_id", "ingest_id").agg(
        F.max_by("run_id", F.struct("page", "run_created_at")).alias("run_id"),
        F.sum("items_received").alias("received"),
        F.sum("items_filtered_out").alias("filtered_out"),
        F.sum("items_duplicate").alias("duplicates"),
        F.sum("items_new").alias("accepted"),
        F.sum("deliveries_created").alias("deliveries_created"),
        F.sum("items_rejected").alias("rejected"),
        F.count(F.lit(1)).alias("pages"),
    )


def request_response(outcomes: DataFrame) -> DataFrame:
    """HTTP status and item list per request.

    The list is bounded by one request body. Counts follow `run_counts`.
    """
    item = F.when(
        _is("accepted", "duplicate", "filtered", "rejected"),
        F.struct(
            F.col("idx").alias("index"),
            F.col("status").alias("status"),
            F.when(_is("accepted", "duplicate"), F.col("event_id")).alias("event_id"),
            F.when(_is("rejected"), F.col("detail")).alias("reason"),
        ),
    )
    # a set per request, not a distinct count: that one would hold and sort every list once more per key
    repeated = F.collect_set(F.when(_is("duplicate"), F.col("dedupe_key")))
    grouped = outcomes.groupBy("pipeline_id", "ingest_id", "run_id").agg(
        F.count_if(_is("accepted", "duplicate", "filtered", "rejected")).alias("received"),
        F.count_if("is_first").alias("accepted"),
        F.size(repeated).cast("bigint").alias("duplicates"),
        F.count_if(_is("filtered")).alias("filtered"),
        F.count_if(_is("rejected", "unsplit")).alias("rejected"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    nothing_new = F.col("accepted") == 0
    http = (
        F.when(nothing_new & (F.col("rejected") == 0) & (F.col("duplicates") > 0), 200)
        .when(nothing_new & (F.col("rejected") > 0), 400)
        .otherwise(202)
    )
    return grouped.withColumn("http_status", http)


def count_by_status(deliveries: DataFrame, pipeline_id: str | None = None) -> DataFrame:
    """One row per flow with a column for each of the five states, zero when there is none."""
    rows = deliveries if pipeline_id is None else deliveries.filter(F.col("pipeline_id") == pipeline_id)
    return rows.groupBy("pipeline_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )


def stuck(deliveries: DataFrame) -> DataFrame:
    """Deliveries given up or failing, per flow and destination."""
    bad = deliveries.filter(F.col("status").isin("FAILED", "DISCARDED"))
    return bad.groupBy("pipeline_id", "destination_id", "status").agg(F.count(F.lit(1)).alias("n"))


def metrics_counters(
    counts: DataFrame | None = None,
    gated: DataFrame | None = None,
    attempts: DataFrame | None = None,
    source_kind: str | None = None,
) -> DataFrame:
    """Counter increments as (metric, pipeline_id, source_kind, destination_id, outcome, reason, value).

    `counts` are run rows, `gated` the ingress gate's output, `attempts` the
    routed attempts of `sluice.operators.delivery`. Plain grouped sums: on a
    stream they run in update mode.
    """
    attributes = ("pipeline_id", "source_kind", "destination_id", "outcome", "reason")
    none = F.lit(None).cast("string")

    def increment(name: str, value: Column, **given: Column) -> Column:
        return F.struct(
            F.lit(name).alias("metric"),
            *[given.get(a, none).cast("string").alias(a) for a in attributes],
            value.cast("bigint").alias("value"),
        )

    parts = []
    if counts is not None:
        names = {
            "items_received": "gateway.items.received",
            "items_filtered_out": "gateway.items.filtered",
            "items_duplicate": "gateway.items.deduplicated",
            "items_new": "gateway.items.accepted",
        }
        given = {"pipeline_id": F.col("pipeline_id"), "source_kind": F.lit(source_kind)}
        steps = [increment(name, F.col(c), **given) for c, name in names.items()]
        parts.append(counts.select(F.inline(F.array(*steps))))
    if gated is not None:
        refused = gated.filter(F.col("status").isNotNull())
        step = increment(
            "gateway.ingress.rejected",
            F.lit(1),
            pipeline_id=F.col("pipeline_id"),
            reason=F.col("status"),
        )
        parts.append(refused.select(F.inline(F.array(step))))
    if attempts is not None:
        place = {"pipeline_id": F.col("pipeline_id"), "destination_id": F.col("destination_id")}
        finished = increment(
            "gateway.deliveries",
            F.lit(1),
            outcome=F.col("outcome"),
            reason=F.col("reason"),
            **place,
        )
        lost = (F.col("outcome") == "ok") & ~F.col("owned")
        twice = increment("gateway.delivery.duplicate_detected", F.lit(1), **place)
        parts.append(
            attempts.select(F.inline(F.array_compact(F.array(finished, F.when(lost, twice)))))
        )
    if not parts:
        raise ValueError("nothing to count")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union.groupBy("metric", *attributes).agg(F.sum("value").alias("value"))


def metrics_histograms(
    rows: DataFrame, value: str, by: Sequence[str], bounds: Sequence[float]
) -> DataFrame:
    """Bucket counts, sum and extremes of a measure; bucket i counts bounds[i-1] < v <= bounds[i]."""
    measure = F.col(value)
    buckets = []
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        test = F.lit(True)
        if low is not None:
            test = test & (measure > low)
        if high is not None:
            test = test & (measure <= high)
        label = "le_inf" if high is None else f"le_{high:g}"
        buckets.append(F.count_if(test).alias(label))
    return (
        rows.filter(measure.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(measure).alias("total"),
            F.min(measure).alias("low"),
            F.max(measure).alias("high"),
            *buckets,
        )
    )


def double_delivery(spark: SparkSession, specs: Sequence[FlowSpec]) -> DataFrame:
    """`double_delivery_rows` of what enabled polling flows are configured to do."""
    rows = [
        (spec.source.url, spec.items_path or "", d.url, spec.id)
        for spec in specs
        if spec.enabled and isinstance(spec.source, PollSource)
        for d in spec.destinations
    ]
    return double_delivery_rows(
        spark.createDataFrame(rows, "source_url string, items_path string, request_url string, pipeline_id string")
    )


def double_delivery_rows(deliveries: DataFrame) -> DataFrame:
    """The same question asked of the data: (source_url, items_path, request_url) used by several flows."""
    place = ("source_url", "items_path", "request_url")
    per_flow = deliveries.groupBy(*place, "pipeline_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_flow.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("n_pipelines"), F.sum("n").alias("n_deliveries"))
        .filter(F.col("n_pipelines") > 1)
    )
