"""The intake plan: documents to outcomes, events, deliveries and run rows.

Everything up to the key is narrow and runs in one stage: split, filter, key,
payload and routes are columns of one projection over the exploded items. The
item itself is dropped there, so a shuffle carries text, not documents. Then
follow one aggregation by key and one join with the ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.predicates import filter_paths, matches
from sluice.functions.reshape import apply_transform
from sluice.functions.variants import bind, canonical_json, drop_paths, extract_paths, fence
from sluice.operators import dedupe
from sluice.operators.audit import item_outcomes
from sluice.operators.fanout import fan_out, route_paths, routes
from sluice.operators.keys import key_parts, key_paths, key_source, missing_detail
from sluice.operators.split import split_entries
from sluice.spec import FlowSpec

EVENT_SCHEMA = (
    "id string, created_at timestamp, pipeline_id string, dedupe_key string, dedupe_source string, "
    "run_id string, run_created_at timestamp, occurred_at timestamp, payload string, "
    "payload_bytes int, routes array<string>"
)


def entries(documents: DataFrame, spec: FlowSpec) -> DataFrame:
    """One row per item with its state, plus marker rows for documents without items.

    `state`: keyed | filtered | rejected | unsplit (document rejected) | empty |
    failed (page error). Only keyed rows carry key, payload and routes.
    """
    split = split_entries(documents, spec.items_path)
    item = F.col("item")
    # filter first: what a filter drops is neither keyed nor routed
    read, tested = extract_paths(split, "item", filter_paths(spec.filter_rules))
    keep = (F.col("entry") == "item") & matches(spec.filter_rules, tested)
    read = drop_paths(bind(read, {"_keep": keep}))
    paths = [*key_paths(spec.dedupe), *route_paths(spec.destinations)]
    read, value_of = extract_paths(read, F.when(F.col("_keep"), item), paths)
    texts, parts = key_parts(read, spec.dedupe, value_of)
    keyed = fence(
        bind(read, texts), {"_source": F.when(F.col("_keep"), key_source(spec.dedupe, parts, item))}
    )
    has_key = F.col("_source").isNotNull()
    state = (
        F.when(F.col("error_code").isNotNull(), "failed")
        .when(F.col("entry") == "rejected", "unsplit")
        .when(F.col("entry") == "empty", "empty")
        .when(~F.col("_keep"), "filtered")
        .when(has_key, "keyed")
        .otherwise("rejected")
    )
    no_key = state == "rejected"
    return keyed.select(
        "pipeline_id",
        "ingest_id",
        "run_id",
        "run_created_at",
        "page",
        "http_status",
        "total_record_count",
        "error_code",
        "error_message",
        "idx",
        state.alias("state"),
        F.when(no_key, M.DEDUPE_KEY_MISSING).when(state == "unsplit", F.col("reason")).alias("reason"),
        F.when(no_key, missing_detail(spec.dedupe))
        .when(state == "unsplit", F.col("detail"))
        .alias("detail"),
        F.col("_source").alias("dedupe_source"),
        F.sha2("_source", 256).alias("dedupe_key"),
        F.when(has_key, canonical_json(item)).alias("payload"),
        F.when(has_key, routes(spec.destinations, value_of)).alias("routes"),
        *(["about"] if "about" in keyed.columns else []),
    )


@dataclass(frozen=True)
class Intake:
    """Outputs of one intake; each plan is built when it is asked for."""

    spec: FlowSpec
    now: datetime | Column
    entries: DataFrame
    resolved: DataFrame
    # The same keys without the contents of their items.
    keys: DataFrame

    @cached_property
    def events(self) -> DataFrame:
        return dedupe.new_events(self.resolved)

    @cached_property
    def deliveries(self) -> DataFrame:
        return fan_out(self.events, self.spec, self.now)

    @cached_property
    def outcomes(self) -> DataFrame:
        return item_outcomes(self.entries, self.keys)


def empty_ledger(documents: DataFrame) -> DataFrame:
    return documents.sparkSession.createDataFrame([], EVENT_SCHEMA)


def plan_intake(
    documents: DataFrame,
    spec: FlowSpec,
    now: datetime | Column,
    ledger: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    route_on: str = "last",
    stage: str | None = None,
) -> Intake:
    """All outputs of an intake, lazily.

    `ledger` are the stored events, or a lookup that gives those of a frame of keys.

    Outcomes need the entries and the resolved keys more than once. With a
    `stage` folder both are written there first and read back, which cuts the
    lineage and parses every body once; without one, Spark computes them anew
    for every use.
    """
    ledger = empty_ledger(documents) if ledger is None else ledger
    rows = entries(documents, spec)
    if stage is not None:
        rows = staged(rows, f"{stage}/entries")
    keyed = rows.filter(F.col("state") == "keyed")
    if not isinstance(ledger, DataFrame):
        ledger = ledger(keyed.select(*dedupe.KEY))
    resolved = dedupe.resolve(dedupe.first_occurrences(keyed, route_on), ledger)
    if stage is not None:
        resolved = keys = staged(resolved, f"{stage}/resolved")
    else:
        keys = dedupe.resolve(dedupe.first_occurrences(keyed, route_on, contents=False), ledger)
    return Intake(spec, now, rows, resolved, keys)


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder every executor reaches: `spark.checkpoint.dir`, else `fallback`."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Write rows once and go on from the files, with columns pruned per use."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dry_run(documents: DataFrame, spec: FlowSpec) -> DataFrame:
    """What an intake would do, item by item; nothing is written.

    `verdict`: filtered | rejected | transform_failed | ready | unsplit. Ready items
    show the body that would be sent.
    """
    split = split_entries(documents, spec.items_path).filter(F.col("entry").isin("item", "rejected"))
    item = F.col("item")
    paths = [*filter_paths(spec.filter_rules), *key_paths(spec.dedupe)]
    read, value_of = extract_paths(split, "item", paths)
    texts, parts = key_parts(read, spec.dedupe, value_of)
    passed = bind(read, {**texts, "_keep": matches(spec.filter_rules, value_of)})
    staged = fence(passed, {"dedupe_source": key_source(spec.dedupe, parts, item)})
    staged = apply_transform(drop_paths(staged), spec.transform_rules, "item", "_body", "_problem")
    verdict = (
        F.when(F.col("entry") == "rejected", "unsplit")
        .when(~F.col("_keep"), "filtered")
        .when(F.col("dedupe_source").isNull(), "rejected")
        .when(F.col("_problem").isNotNull(), "transform_failed")
        .otherwise("ready")
    )
    return staged.select(
        "pipeline_id",
        "run_id",
        "page",
        "idx",
        verdict.alias("verdict"),
        F.when(verdict.isin("ready", "transform_failed"), F.col("dedupe_source")).alias("dedupe_source"),
        F.when(verdict == "ready", F.col("_body")).alias("body"),
        F.when(verdict == "unsplit", F.col("detail"))
        .when(verdict == "rejected", missing_detail(spec.dedupe))
        .when(verdict == "transform_failed", F.col("_problem"))
        .alias("detail"),
    )


def dry_run_summary(documents: DataFrame, spec: FlowSpec) -> DataFrame:
    plan = dry_run(documents, spec)
    verdict = F.col("verdict")
    return plan.groupBy("pipeline_id").agg(
        F.count_if(verdict != "unsplit").alias("received"),
        F.count_if(verdict == "filtered").alias("filtered"),
        F.count_if(verdict.isin("rejected", "transform_failed")).alias("no_key_or_transform"),
        F.count_if(verdict == "ready").alias("ready"),
    )
