"""Streams give what the batch operators give."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from sluice.operators.keys import with_dedupe_key
from sluice.plans import frames
from sluice.plans.run import run_batch
from sluice.sinks.ledger import Ledger, append_deliveries, open_ledger, open_deliveries
from sluice.sources.pages import page_documents
from sluice.spec import DedupeSpec, DestinationSpec, FlowSpec, PollSource, RetrySpec
from sluice.streaming.dedupe import dedupe_stream
from sluice.streaming.delivery import INITIAL_SCHEMA, DeliveryProcessor, DeliveryShares, delivery_state_stream
from sluice.streaming.intake import run_stream
from sluice.streaming.rates import rate_counts


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


EVENT = ("id", "dedupe_key", "dedupe_source", "payload", "payload_bytes", "run_id")
DELIVERY = ("id", "destination_id", "event_id", "status", "request_url", "max_attempts")
RUN = ("id", "status", "items_received", "items_filtered_out", "items_duplicate", "items_new", "deliveries_created", "error_code")


def _tables(spark, ledger):
    return (
        _rows(spark.table(ledger.table("events")), *EVENT),
        _rows(spark.table(ledger.table("deliveries")), *DELIVERY),
        _rows(spark.table(ledger.table("runs")), *RUN),
    )


def test_batch_replay_and_stream_equal(spark, sf_dir, tmp_path):
    spec = frames.poll_flow()
    pages = frames.landed_pages(spark, sf_dir)
    landing = str(tmp_path / "landing")
    pages.coalesce(1).write.parquet(landing)
    landed = spark.read.parquet(landing)

    batch = open_ledger(spark, Ledger(str(tmp_path / "batch"), "t_batch", buckets=4))
    run_batch(page_documents(landed, spec), spec, batch, "b1", frames.NOW)
    first = _tables(spark, batch)
    assert len(first[0]) > 0 and len(first[2]) == page_documents(landed, spec).count()

    # the same batch again changes nothing
    run_batch(page_documents(landed, spec), spec, batch, "b1", frames.NOW)
    assert _tables(spark, batch) == first

    # the same pages as another batch: everything is a duplicate
    outcomes = run_batch(page_documents(landed, spec), spec, batch, "b2", frames.NOW)
    statuses = {r["status"] for r in outcomes.select("status").distinct().collect()}
    assert "accepted" not in statuses and "duplicate" in statuses
    assert _rows(spark.table(batch.table("events")), *EVENT) == first[0]
    ids = {r[0] for r in first[0]}
    found = outcomes.filter(F.col("status") == "duplicate").select("event_id").collect()
    assert {r[0] for r in found} <= ids

    stream = Ledger(str(tmp_path / "stream"), "t_stream", buckets=4)
    open_ledger(spark, stream)
    source = spark.readStream.schema(landed.schema).parquet(landing)
    query = run_stream(source, spec, stream, str(tmp_path / "ck"), clock=lambda: frames.NOW)
    query.awaitTermination(300)
    assert query.exception() is None
    spark.catalog.refreshTable(stream.table("events"))
    open_ledger(spark, stream)
    assert _tables(spark, stream) == first


def test_ledger_lookup_does_not_shuffle_the_ledger(spark, sf_dir, tmp_path):
    from sluice.operators import dedupe
    from sluice.plans.intake import entries
    from sluice.sinks.ledger import events_of

    spec = frames.poll_flow()
    ledger = open_ledger(spark, Ledger(str(tmp_path / "l"), "t_plan", buckets=4))
    docs = page_documents(frames.landed_pages(spark, sf_dir), spec)
    run_batch(docs, spec, ledger, "b1", frames.NOW)
    keyed = entries(docs, spec).filter(F.col("state") == "keyed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        resolved = dedupe.resolve(dedupe.first_occurrences(keyed), events_of(spark, ledger))
        plan = resolved._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ledger_side = plan[plan.index("SortMergeJoin") :].split("FileScan parquet spark_catalog")[0]
    assert "Bucketed: true" in plan
    assert ledger_side.rindex("Sort [") > ledger_side.rindex("Exchange")


def test_closed_deliveries_leave_the_open_partition(spark, sf_dir, tmp_path):
    ledger = open_ledger(spark, Ledger(str(tmp_path / "l"), "t_open", buckets=2))
    rows = frames.deliveries(spark, sf_dir)
    append_deliveries(rows, ledger, "b1")
    kept = open_deliveries(spark, ledger)
    assert kept.count() == rows.filter(F.col("status").isin("PENDING", "FAILED", "IN_FLIGHT")).count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_open" in plan


def test_dedupe_stream(spark, sf_dir, tmp_path):
    spec = DedupeSpec(fields=("code", "type"))
    landing = str(tmp_path / "events")
    frames.table(spark, sf_dir, "events").coalesce(2).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    events = spark.readStream.schema(schema).parquet(landing)
    items = events.select(
        F.lit("f").alias("pipeline_id"),
        F.col("ts").cast("timestamp").alias("run_created_at"),
        F.parse_json(frames.item_json()).alias("item"),
    )
    kept = dedupe_stream(with_dedupe_key(items, spec), spec)
    query = (
        kept.select("pipeline_id", "dedupe_key")
        .writeStream.format("memory")
        .queryName("deduped")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    want = spark.read.parquet(landing).select("user_id", "event_type").distinct().count()
    got = spark.table("deduped")
    assert got.count() == got.distinct().count() == want


def test_rate_counts_on_a_stream(spark, sf_dir, tmp_path):
    landing = str(tmp_path / "events")
    frames.table(spark, sf_dir, "events").coalesce(1).write.parquet(landing)
    table = spark.read.parquet(landing).withColumn("ts", frames.utc("ts"))
    stream = (
        spark.readStream.schema(spark.read.parquet(landing).schema)
        .parquet(landing)
        .withColumn("ts", frames.utc("ts"))
    )
    query = (
        rate_counts(stream, by="event_type", ts="ts")
        .writeStream.format("memory")
        .queryName("rates")
        .outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    want = rate_counts(table, by="event_type", ts="ts")
    columns = ("event_type", "minute", "n")
    assert _rows(spark.table("rates"), *columns) == _rows(want, *columns)


def test_delivery_state_stream(spark, tmp_path):
    flow = FlowSpec(
        id="f",
        source=PollSource(url="https://o.example", items_path="itens"),
        dedupe=DedupeSpec(fields=("id",)),
        transform={},
        destinations=(DestinationSpec(id="d", url="https://d.example", retry=RetrySpec(attempts=3, jitter=0)),),
    )
    schema = (
        "delivery_id string, pipeline_id string, destination_id string, max_attempts int, "
        "finished_at timestamp, net_code string, status int, headers map<string,string>"
    )

    def at(minute: int) -> datetime:
        return datetime(2024, 1, 1, 0, minute)

    batches = [
        [
            ("a", "f", "d", 3, at(0), None, 500, None),
            ("b", "f", "d", 3, at(0), None, 200, None),
            ("c", "f", "d", 3, at(0), None, 404, None),
            ("e", "f", "d", 1, at(0), "ETIMEDOUT", None, None),
        ],
        [
            ("a", "f", "d", 3, at(1), None, 503, {"retry-after": "60"}),
            ("b", "f", "d", 3, at(1), None, 200, None),
        ],
        [("z", "f", "d", 3, at(50), None, 200, None)],
        [("z", "f", "d", 3, at(51), None, 200, None)],
    ]
    landing = str(tmp_path / "results")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    query = (
        delivery_state_stream(stream, [flow], late="1 minute")
        .writeStream.format("memory")
        .queryName("states")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    got = {(r.delivery_id, r.status, r.attempts, r.reason) for r in spark.table("states").collect()}
    assert ("b", "DELIVERED", 1, None) in got
    assert ("c", "DISCARDED", 1, "NON_RETRYABLE_STATUS") in got
    assert ("e", "DISCARDED", 1, "ATTEMPTS_EXHAUSTED") in got
    assert ("a", "FAILED", 1, "HTTP_500") in got
    assert ("a", "FAILED", 2, "HTTP_503") in got
    assert ("a", "DUE", 2, None) in got
    assert not any(r[0] == "b" and r[2] > 1 for r in got)
    due = {r.due_ms - r.at_ms for r in spark.table("states").collect() if r.delivery_id == "a" and r.status == "FAILED"}
    assert due == {15_000, 60_000}


def test_pages_of_a_cycle_over_several_triggers_and_out_of_order(spark, sf_dir, tmp_path):
    spec = frames.poll_flow()
    landed = frames.landed_pages(spark, sf_dir)
    rows = landed.filter("cycle_id < 4").collect()
    kept = spark.createDataFrame(rows, landed.schema)
    landing = str(tmp_path / "landing")
    # later pages first; the last file only moves the watermark on
    for share in (3, 1, 0, 2):
        mine = [r for r in rows if r.page % 4 == share]
        spark.createDataFrame(mine, landed.schema).coalesce(1).write.mode("append").parquet(landing)
    late = frames.NOW + timedelta(hours=9)
    for i in range(2):
        end = [(99, 1 + i, late + timedelta(hours=i), '{"itens":[]}', 200)]
        spark.createDataFrame(end, landed.schema).coalesce(1).write.mode("append").parquet(landing)

    batch = open_ledger(spark, Ledger(str(tmp_path / "batch"), "t_cycle_batch", buckets=2))
    run_batch(page_documents(kept, spec), spec, batch, "b", frames.NOW)
    stream = open_ledger(spark, Ledger(str(tmp_path / "stream"), "t_cycle_stream", buckets=2))
    source = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    query = run_stream(source, spec, stream, str(tmp_path / "ck"), clock=lambda: frames.NOW, hold=timedelta(minutes=30))
    query.awaitTermination(600)
    assert query.exception() is None
    open_ledger(spark, stream)
    assert _tables(spark, stream) == _tables(spark, batch)


def test_finished_deliveries_are_forgotten_and_a_stream_starts_from_stored_state(spark, tmp_path):
    flow = FlowSpec(
        id="f",
        source=PollSource(url="https://o.example", items_path="itens"),
        dedupe=DedupeSpec(fields=("id",)),
        transform={},
        destinations=(DestinationSpec(id="d", url="https://d.example", retry=RetrySpec(attempts=3, jitter=0)),),
    )
    schema = (
        "delivery_id string, pipeline_id string, destination_id string, max_attempts int, "
        "finished_at timestamp, net_code string, status int, headers map<string,string>"
    )

    def at(hour: int) -> datetime:
        return datetime(2024, 1, 1, hour)

    landing = str(tmp_path / "results")

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(landing)

    known = spark.createDataFrame([("w", "FAILED", 2, None), ("p", "PENDING", 0, None)], INITIAL_SCHEMA)

    def run(first: bool):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        changes = delivery_state_stream(source, [flow], "1 minute", timedelta(hours=1), known)
        query = (
            changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
        return query

    ok = ("f", "d", 3)
    land(("w", *ok, at(0), None, 500, None), ("b", *ok, at(0), None, 200, None), ("c", *ok, at(0), None, 404, None))
    run(True)
    land(("z", *ok, at(5), None, 500, None))
    land(("z", *ok, at(6), None, 500, None))
    run(False)
    got = {(r.delivery_id, r.status, r.attempts) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("w", "DISCARDED", 3) in got, "the stored attempts count"
    assert {("b", "DELIVERED", 1), ("c", "DISCARDED", 1), ("z", "FAILED", 2)} <= got
    left = spark.read.format("statestore").option("stateVarName", "delivery").load(str(tmp_path / "ck"))
    assert {r.key.delivery_id for r in left.select("key").collect()} == {"p", "z"}, "b, c and w are forgotten"


class _Asked:
    """The state of one delivery, and what was asked of it."""

    def __init__(self):
        self.value, self.timers, self.asked = None, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = value

    def clear(self):
        self.asked.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.asked.append("register")
        self.timers.append(at)

    def listTimers(self):
        self.asked.append("list")
        return iter(self.timers)

    def deleteTimer(self, at):
        self.asked.append("delete")
        self.timers.remove(at)


def test_a_delivery_asks_its_state_as_little_as_it_can():
    state, processor = _Asked(), DeliveryProcessor(1_000)
    processor.init(state)

    def come(*results):
        state.asked.clear()
        rows = [Row(at_ms=at, kind=kind, why="w", max_attempts=3, delays=[5, 7, 9]) for at, kind in results]
        return [tuple(r) for r in processor.handleInputRows(("a",), iter(rows), None)], list(state.asked)

    assert come((20, "RETRYABLE"), (10, "RETRYABLE")) == ([("a", 10, "FAILED", 1, "w", 15), ("a", 20, "FAILED", 2, "w", 27)], ["get", "register", "update"])
    assert state.timers == [27]
    assert come((30, "SUCCESS")) == ([("a", 30, "DELIVERED", 3, None, None)], ["get", "list", "delete", "register", "update"])
    assert state.timers == [1_030]
    assert come((40, "RETRYABLE")) == ([], ["get"])
    assert list(processor.handleExpiredTimer(("a",), None, None)) == [] and state.value is None


def test_shares_give_the_changes_of_single_deliveries(spark, tmp_path):
    flow = FlowSpec(
        id="f",
        source=PollSource(url="https://o.example", items_path="itens"),
        dedupe=DedupeSpec(fields=("id",)),
        transform={},
        destinations=(DestinationSpec(id="d", url="https://d.example", retry=RetrySpec(attempts=3, jitter=0)),),
    )
    schema = (
        "delivery_id string, pipeline_id string, destination_id string, max_attempts int, "
        "finished_at timestamp, net_code string, status int, headers map<string,string>"
    )
    draw = random.Random(7)
    landing = str(tmp_path / "results")
    names = [f"n{i}" for i in range(12)] + [None]
    for hour in range(5):
        rows = [
            (draw.choice(names), "f", "d", draw.choice([1, 3, 9, None]), datetime(2024, 1, 1, hour) + timedelta(seconds=i), draw.choice([None, None, "ETIMEDOUT"]),
             draw.choice([200, 404, 500, 503]), draw.choice([None, {"retry-after": "60"}]))
            for i in range(15)
        ]
        # due 46 s before the next hour, which is the very watermark after the next batch
        rows += [(f"e{hour}", "f", "d", 9, datetime(2024, 1, 1, hour), None, 500, {"retry-after": str(3_600 - 46)})]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    known = spark.createDataFrame([("n0", "FAILED", 2, 1704067100000), ("n1", "PENDING", 0, None), ("w", "FAILED", 1, 1704067200000), ("q", "IN_FLIGHT", 1, None)], INITIAL_SCHEMA)

    def run(name: str, stored, shares: int | None) -> list[tuple]:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        changes = delivery_state_stream(source, [flow], "1 minute", timedelta(minutes=90), stored, shares)
        query = (
            changes.writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
        return sorted((tuple(r) for r in spark.table(name).collect()), key=repr)

    for name, stored in (("plain", None), ("stored", known)):
        single = run(f"{name}_single", stored, None)
        assert {r[2] for r in single} == {"DELIVERED", "DISCARDED", "FAILED", "DUE"}
        assert run(f"{name}_shares", stored, 3) == single
    left = spark.read.format("statestore").option("stateVarName", "shares").load(str(tmp_path / "stored_shares"))
    single = spark.read.format("statestore").option("stateVarName", "delivery").load(str(tmp_path / "stored_single"))
    held = [d for r in left.select("value.ids").collect() for d in r.ids]
    assert sorted(held, key=repr) == sorted((r.d for r in single.select(F.col("key.delivery_id").alias("d")).collect()), key=repr)


def test_a_share_asks_its_state_once_for_all_its_deliveries():
    state, processor = _Asked(), DeliveryShares(1_000)
    processor.init(state)

    def come(*results):
        state.asked.clear()
        frame = pd.DataFrame([(d, at, kind, "w", 3, [5, 7, 9]) for d, at, kind in results], columns=["delivery_id", "at_ms", "kind", "why", "max_attempts", "delays"])
        return sum(len(f) for f in processor.handleInputRows((0,), iter([frame]), None)), list(state.asked)

    assert come(*[(f"a{i}", 20 + i, "RETRYABLE") for i in range(500)]) == (500, ["get", "register", "update"])
    assert state.timers == [25]
    assert come(*[(f"a{i}", 900, "SUCCESS") for i in range(400)]) == (400, ["get", "delete", "register", "update"])
    assert state.timers == [425]
    assert come(("a0", 950, "RETRYABLE")) == (0, ["get"])
    state.asked.clear()
    state.timers.clear()  # as Spark does with the timer that expired
    due = pd.concat(processor.handleExpiredTimer((0,), TimerValues(0, 500), None))
    assert set(due["delivery_id"]) == {f"a{i}" for i in range(400, 476)} and state.asked == ["get", "register", "update"]
    assert state.timers == [501]
