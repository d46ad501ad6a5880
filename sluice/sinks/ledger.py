"""Where events, deliveries and run rows are kept.

Events: a Parquet table bucketed and sorted on `dedupe_key`, one partition per
batch. The lookup of a batch reads the key columns only and does not shuffle
the ledger. Batches are merged level by level (`compact_events`), so the ledger
has as many partitions as the logarithm of its batches, and `rebucket` doubles
the buckets when they get too full. A manifest says which partitions count: a
merge is one step for readers. Beside each partition lie sketches of its keys
(`sluice.sinks.sketch`); `seen_events` opens the files only that can hold a key
of the batch. Deliveries: one partition per month and batch, and per
`is_open`, so the state machine reads the few open rows only. Runs: per month
and batch.

Writes name their batch and replace its partitions, so a batch can be repeated
after a lost executor or driver. One writer per ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.dates import month_partition
from sluice.operators.dedupe import KEY
from sluice.operators.delivery import DELIVERY_COLUMNS, OPEN, as_deliveries
from sluice.operators.tables import keys_fit
from sluice.plans.intake import EVENT_SCHEMA
from sluice.sinks import files
from sluice.sinks.manifest import Entry, Manifest, Version, levels_to_merge
from sluice.sinks.sketch import SKETCH_SCHEMA, hits, sketches

RUN_SCHEMA = (
    "id string, created_at timestamp, pipeline_id string, run_group_id string, `trigger` string, "
    "status string, request_page int, http_status smallint, total_record_count int, "
    "items_received int, items_filtered_out int, items_duplicate int, items_new int, "
    "deliveries_created int, error_code string, error_message string, request_url string, "
    "content_type string, body_bytes int, source_ip string, duration_ms int, finished_at timestamp, "
    "trace_id string"
)
# Readers of single keys (find_events, find_deliveries) skip row groups by it.
_BUCKET = re.compile(r"_(\d{5})\.c\d+")
_BLOOM = "'parquet.bloom.filter.enabled#dedupe_key' 'true'"


@dataclass(frozen=True)
class Ledger:
    """Paths of one ledger plus the name prefix its tables get in the session catalog."""

    root: str
    name: str = "sluice"
    buckets: int = 64
    fan: int = 4

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def manifest(self, spark: SparkSession) -> Manifest:
        return Manifest(spark, self.path("versions"))

    def table(self, table: str) -> str:
        return f"{self.name}_{table}"


def open_ledger(spark: SparkSession, ledger: Ledger) -> Ledger:
    """Register the tables over their paths; safe to repeat, and in a new session."""
    columns = ", ".join(f"{c} {t}" for c, t in DELIVERY_COLUMNS.items())
    definitions = {
        "deliveries": (
            f"{columns}, created_month string, is_open boolean, batch_id string",
            ("created_month", "is_open", "batch_id"),
            "",
        ),
        "runs": (
            f"{RUN_SCHEMA}, created_month string, batch_id string",
            ("created_month", "batch_id"),
            "",
        ),
    }
    _register_events(spark, ledger, ledger.manifest(spark).load().layout)
    for table, (schema, partitions, clustering) in definitions.items():
        _register(spark, ledger, table, table, schema, partitions, clustering)
    refresh(spark, ledger)
    return ledger


def _register_events(spark: SparkSession, ledger: Ledger, layout: int, table: str = "events") -> None:
    """The event table with `buckets` doubled `layout` times; each layout has a folder of its own."""
    buckets = buckets_of(ledger, layout)
    by_key = f"CLUSTERED BY (dedupe_key) SORTED BY (dedupe_key) INTO {buckets} BUCKETS"
    _register(spark, ledger, table, _events_folder(layout), f"{EVENT_SCHEMA}, batch_id string", ("batch_id",), by_key)


def _events_folder(layout: int) -> str:
    return f"events-{layout}" if layout else "events"


def buckets_of(ledger: Ledger, layout: int) -> int:
    return ledger.buckets << layout


def _register(
    spark: SparkSession, ledger: Ledger, table: str, folder: str, schema: str, partitions: tuple, clustering: str
) -> None:
    # the folder has to be there before its partitions can be looked for
    nothing = spark.createDataFrame([], schema)
    nothing.write.mode("ignore").partitionBy(*partitions).parquet(ledger.path(folder))
    bloom = "" if table == "runs" else f"OPTIONS ({_BLOOM}) "
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {ledger.table(table)} ({schema}) USING parquet {bloom}"
        f"PARTITIONED BY ({', '.join(partitions)}) {clustering} LOCATION '{ledger.path(folder)}'"
    )


def refresh(spark: SparkSession, ledger: Ledger) -> None:
    """Pick up partitions written by another session."""
    for table in ("events", "deliveries", "runs"):
        spark.sql(f"ALTER TABLE {ledger.table(table)} RECOVER PARTITIONS")
        spark.catalog.refreshTable(ledger.table(table))


def _insert(rows: DataFrame, ledger: Ledger, table: str) -> None:
    spark = rows.sparkSession
    schema = spark.table(ledger.table(table)).schema
    given = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*given).write.insertInto(ledger.table(table), overwrite=True)


def append_events(events: DataFrame, ledger: Ledger, batch_id: str) -> None:
    """Write the events of a batch with their sketches; repeating the newest batch replaces it.

    The rows are clustered like the buckets first, which gives one file per
    bucket and batch instead of one per task and bucket.
    """
    spark = events.sparkSession
    newest, start = ledger.manifest(spark).start_of(batch_id)
    rows = _write_partition(events, ledger, newest.layout, batch_id)
    held = [e for e in start.entries if e.part != batch_id]
    # A batch without new events has no partition.
    entries = [Entry(newest.number + 1, batch_id, 0, rows)] if rows else []
    ledger.manifest(spark).commit(newest, batch_id, start.number, [*held, *entries])


def _write_partition(rows: DataFrame, ledger: Ledger, layout: int, name: str, table: str = "events") -> int:
    spark, buckets = rows.sparkSession, buckets_of(ledger, layout)
    clustered = rows.drop("batch_id").repartition(buckets, "dedupe_key")
    _insert(clustered.withColumn("batch_id", F.lit(name)), ledger, table)
    stored = spark.table(ledger.table(table)).filter(F.col("batch_id") == name)
    made = sketches(stored, buckets)
    made.write.mode("overwrite").parquet(f"{ledger.path('sketches')}/{layout}/batch_id={name}")
    counted = spark.read.schema(SKETCH_SCHEMA).parquet(f"{ledger.path('sketches')}/{layout}/batch_id={name}")
    return counted.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]


def compact_events(spark: SparkSession, ledger: Ledger) -> Version:
    """Merge the newest batch partitions while a level holds `fan` of them. The old ones go once the merge counts."""
    manifest = ledger.manifest(spark)
    version = manifest.load()
    due = levels_to_merge(sorted(version.entries, key=lambda e: e.seg), ledger.fan)
    if not due:
        return version
    level, parts = 1 + max(e.level for e in due), [e.part for e in due]
    name = f"level{level}-{version.number + 1:012d}"
    rows = _write_partition(_plain(spark, ledger, version.layout, parts), ledger, version.layout, name)
    rest = [e for e in version.entries if e not in due]
    # The newest batch is part of the merge: it can no longer be repeated on its own, and need not be.
    made = manifest.commit(version, None, 0, [*rest, Entry(version.number + 1, name, level, rows)], version.layout)
    _drop_partitions(spark, ledger, version.layout, parts)
    return made


def rebucket(spark: SparkSession, ledger: Ledger, rows_per_bucket: int = 4_000_000) -> Version:
    """Double the buckets until they hold `rows_per_bucket` at most, rewriting all events as one partition."""
    manifest = ledger.manifest(spark)
    version = manifest.load()
    total, layout = sum(e.rows for e in version.entries), version.layout
    while total > rows_per_bucket * buckets_of(ledger, layout):
        layout += 1
    if layout == version.layout:
        return version
    level = max(e.level for e in version.entries)
    name = f"level{level}-{version.number + 1:012d}"
    _register_events(spark, ledger, layout, "events_next")
    rows = _write_partition(_plain(spark, ledger, version.layout, version.parts()), ledger, layout, name, "events_next")
    made = manifest.commit(version, None, 0, [Entry(version.number + 1, name, level, rows)], layout)
    for table in ("events", "events_next"):
        spark.sql(f"DROP TABLE {ledger.table(table)}")
    _register_events(spark, ledger, layout)
    refresh(spark, ledger)
    files.remove(spark, ledger.path(_events_folder(version.layout)))
    files.remove(spark, f"{ledger.path('sketches')}/{version.layout}")
    return made


def remove_events(spark: SparkSession, ledger: Ledger, victims: DataFrame) -> int:
    """Remove events by key; returns how many. The batch partitions that hold victims become one without them."""
    manifest = ledger.manifest(spark)
    version = manifest.load()
    held = _partitions(spark, ledger, version.parts())
    counts = held.select(*KEY, "batch_id").join(victims.select(*KEY), list(KEY), "left_semi").groupBy("batch_id").count().collect()
    touched = {r["batch_id"]: r["count"] for r in counts}
    if not touched:
        return 0
    due = [e for e in version.entries if e.part in touched]
    level = max(e.level for e in due)
    name = f"level{level}-{version.number + 1:012d}"
    kept = _plain(spark, ledger, version.layout, sorted(touched)).join(victims.select(*KEY), list(KEY), "left_anti")
    rows = _write_partition(kept, ledger, version.layout, name)
    rest = [e for e in version.entries if e.part not in touched]
    manifest.commit(version, None, 0, [*rest, *([Entry(version.number + 1, name, level, rows)] if rows else [])])
    _drop_partitions(spark, ledger, version.layout, sorted(touched))
    return sum(touched.values())


def _drop_partitions(spark: SparkSession, ledger: Ledger, layout: int, parts: list[str]) -> None:
    for part in parts:
        spark.sql(f"ALTER TABLE {ledger.table('events')} DROP IF EXISTS PARTITION (batch_id = '{part}')")
        files.remove(spark, f"{ledger.path(_events_folder(layout))}/batch_id={part}")
        files.remove(spark, f"{ledger.path('sketches')}/{layout}/batch_id={part}")


def _plain(spark: SparkSession, ledger: Ledger, layout: int, parts: list[str]) -> DataFrame:
    """The rows of batch partitions as plain files: rewriting them clusters them anew, whatever their buckets are."""
    folder = ledger.path(_events_folder(layout))
    reader = spark.read.schema(f"{EVENT_SCHEMA}, batch_id string").option("basePath", folder)
    return reader.parquet(*[f"{folder}/batch_id={p}" for p in parts])


def _partitions(spark: SparkSession, ledger: Ledger, parts: list[str]) -> DataFrame:
    return spark.table(ledger.table("events")).filter(F.col("batch_id").isin(parts))


def seen_events(keys: DataFrame, ledger: Ledger, before: str | None = None) -> DataFrame:
    """Key, id and instant of the stored events whose keys are among `keys`.

    The sketches name the bucket files to open. What they let through is a few
    keys for a batch of new items, so it is broadcast if it fits; else the keys
    meet the bucketed table, which is not shuffled.
    """
    spark = keys.sparkSession
    version = _version(spark, ledger, before)
    columns = (*KEY, "id", "created_at")
    if not version.entries:
        return events_of(spark, ledger, before).select(*columns)
    layout, parts = version.layout, version.parts()
    paths = [f"{ledger.path('sketches')}/{layout}/batch_id={p}" for p in parts]
    stored = spark.read.schema(f"{SKETCH_SCHEMA}, batch_id string").option("basePath", f"{ledger.path('sketches')}/{layout}").parquet(*paths)
    found = hits(keys.select(*KEY).distinct(), stored, buckets_of(ledger, layout)).persist()
    touched = found.groupBy("batch_id", "bucket").count().collect()  # at most one row per file
    n_keys = sum(r["count"] for r in touched)
    wanted = found.select(*KEY).distinct()
    if not keys_fit(n_keys):
        return _partitions(spark, ledger, parts).select(*columns).join(wanted, list(KEY), "left_semi")
    folder = ledger.path(_events_folder(layout))
    opened = bucket_files(spark, folder, {(r["batch_id"], r["bucket"]) for r in touched})
    if not opened:
        return spark.createDataFrame([], spark.table(ledger.table("events")).select(*columns).schema)
    rows = spark.read.schema(EVENT_SCHEMA).parquet(*opened).select(*columns)
    return rows.join(F.broadcast(wanted), list(KEY), "left_semi")


def bucket_files(spark: SparkSession, folder: str, wanted: set[tuple[str, int]]) -> list[str]:
    """Paths of the files of the given (batch, bucket) pairs; a bucket's number is part of its files' names."""
    found = []
    for batch in sorted({b for b, _ in wanted}):
        inside = f"{folder}/batch_id={batch}"
        for name in files.names(spark, inside):
            number = _BUCKET.search(name)
            if number and (batch, int(number[1])) in wanted:
                found.append(f"{inside}/{name}")
    return found


def with_delivery_partitions(deliveries: DataFrame) -> DataFrame:
    return deliveries.withColumns(
        {
            "created_month": month_partition(F.col("created_at")),
            "is_open": F.col("status").isin(*OPEN),
        }
    )


def append_deliveries(deliveries: DataFrame, ledger: Ledger, batch_id: str) -> None:
    rows = with_delivery_partitions(as_deliveries(deliveries))
    _insert(rows.withColumn("batch_id", F.lit(batch_id)), ledger, "deliveries")


def append_runs(runs: DataFrame, ledger: Ledger, batch_id: str) -> None:
    rows = runs.withColumns(
        {"created_month": month_partition(F.col("created_at")), "batch_id": F.lit(batch_id)}
    )
    _insert(rows, ledger, "runs")


def _version(spark: SparkSession, ledger: Ledger, before: str | None) -> Version:
    manifest = ledger.manifest(spark)
    return manifest.load() if before is None else manifest.start_of(before)[1]


def events_of(spark: SparkSession, ledger: Ledger, before: str | None = None) -> DataFrame:
    """The event table; `before` leaves one batch out (the one being repeated)."""
    return _partitions(spark, ledger, _version(spark, ledger, before).parts())


def batch_of(spark: SparkSession, ledger: Ledger, table: str, batch_id: str) -> DataFrame:
    return spark.table(ledger.table(table)).filter(F.col("batch_id") == batch_id)


def open_deliveries(spark: SparkSession, ledger: Ledger) -> DataFrame:
    return spark.table(ledger.table("deliveries")).filter("is_open")
