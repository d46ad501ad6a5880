"""Tables that jobs keep: versions, merges, sketches, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators.retention import policy_frame
from sluice.plans import frames
from sluice.plans.deliver import CycleLimits, add_deliveries, delivery_store, run_cycle
from sluice.plans.intake import EVENT_SCHEMA
from sluice.plans.metrics import add_counters, counter_table, hourly_sketches, quantiles, sketch_table
from sluice.plans.retain import drop_expired_runs
from sluice.plans.run import run_batch
from sluice.sinks import files
from sluice.sinks.keyed import KeyedTable
from sluice.sinks.ledger import (
    Ledger,
    append_events,
    bucket_files,
    compact_events,
    events_of,
    open_ledger,
    rebucket,
    remove_events,
    seen_events,
)
from sluice.sinks.manifest import Entry, levels_to_merge
from sluice.sinks.sketch import hits
from sluice.sources.pages import page_documents

SCHEMA = "id string, n int, month string, state string"


def keyed(spark, path, fan=4):
    return KeyedTable(spark, str(path), SCHEMA, ("id",), "month", "state", fan)


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(frame):
    return sorted(map(tuple, frame.select("id", "n", "month", "state").collect()))


def test_levels_keep_entries_logarithmic():
    entries, rewritten = [], 0
    for seg in range(1, 257):
        entries.append(Entry(seg, "p", 0, 1))
        due = levels_to_merge(entries, 4)
        if due:
            rewritten += sum(e.rows for e in due)
            assert due == entries[-len(due) :], "only the newest entries are merged"
            entries = [e for e in entries if e not in due]
            entries.append(Entry(seg, "p", 1 + max(e.level for e in due), sum(e.rows for e in due)))
        assert len(entries) <= 3 * 5 + 1
    assert sum(e.rows for e in entries) == 256 and rewritten <= 256 * 4


def test_newest_row_counts_and_rows_leave_their_split(spark, tmp_path):
    table = keyed(spark, tmp_path)
    assert content(table.read()) == []
    table.upsert("b1", rows_of(spark, ("a", 1, "01", "open"), ("b", 1, "01", "open"), ("c", 1, "02", "open")))
    table.upsert("b2", rows_of(spark, ("a", 2, "01", "closed")))
    table.upsert("b3", rows_of(spark, ("a", 3, "01", "closed"), ("d", 3, "02", "open")))
    everything = [("a", 3, "01", "closed"), ("b", 1, "01", "open"), ("c", 1, "02", "open"), ("d", 3, "02", "open")]
    assert content(table.read()) == everything
    assert content(table.read(split="open")) == everything[1:]
    assert content(table.read(split="closed")) == everything[:1]
    assert content(table.read(parts="02".__eq__)) == everything[2:]
    assert content(table.read(table.manifest.load(1))) == [("a", 1, "01", "open"), ("b", 1, "01", "open"), ("c", 1, "02", "open")]


def test_repeated_batch_replaces_itself_even_after_a_merge(spark, tmp_path):
    table = keyed(spark, tmp_path, fan=2)
    table.upsert("b1", rows_of(spark, ("a", 1, "01", "open")))
    table.upsert("b2", rows_of(spark, ("a", 9, "01", "open"), ("x", 9, "01", "open")))
    table.compact()
    table.upsert("b2", rows_of(spark, ("a", 2, "01", "open")))
    assert content(table.read()) == [("a", 2, "01", "open")]
    table.upsert("b3", rows_of(spark))
    assert content(table.read()) == [("a", 2, "01", "open")]


def test_a_batch_that_did_not_commit_is_not_seen_and_two_writers_clash(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.upsert("b1", rows_of(spark, ("a", 1, "01", "open")))
    newest = table.manifest.load()
    table._write(rows_of(spark, ("a", 5, "01", "open"), ("z", 5, "01", "open")), newest.number + 1, 0)  # a driver lost here
    assert content(table.read()) == [("a", 1, "01", "open")]
    table.upsert("b2", rows_of(spark, ("b", 2, "01", "open")))
    assert content(table.read()) == [("a", 1, "01", "open"), ("b", 2, "01", "open")]
    with pytest.raises(FileExistsError):
        table.manifest.commit(newest, "other", 0, [])


def test_merges_and_deletes_rewrite_the_touched_months_only(spark, tmp_path):
    table = keyed(spark, tmp_path, fan=3)
    table.upsert("b0", rows_of(spark, *[(f"k{i}", 0, f"{i % 4:02}", "open") for i in range(40)]))
    for b in range(1, 8):
        table.upsert(f"b{b}", rows_of(spark, (f"k{b}", b, f"{b % 4:02}", "closed"), ("k1", 10 + b, "01", "open")))
        table.compact()
    version = table.manifest.load()
    assert max(len(version.of_part(p)) for p in version.parts()) <= 2 * 3 + 1
    before = dict((r[0], r) for r in content(table.read()))
    assert before["k1"][1] == 17 and before["k5"][1:] == (5, "01", "closed") and len(before) == 40
    untouched = {(e.seg, e.part) for e in version.entries if e.part != "02"}
    after = table.delete(rows_of(spark, ("k2", 0, "02", ""), ("k6", 0, "02", ""), ("nobody", 0, "03", "")))
    assert {(e.seg, e.part) for e in after.entries if e.part != "02"} == untouched
    assert content(table.read()) == sorted(r for k, r in before.items() if k not in ("k2", "k6"))
    assert table.delete(rows_of(spark, ("nobody", 0, "03", ""))).number == after.number
    table.drop_parts(["00", "01"])
    table.expire(keep=1)
    assert {r[2] for r in content(table.read())} == {"02", "03"}
    left = {p for seg in files.names(spark, table.data) for p in files.names(spark, f"{table.data}/{seg}") if "=" in p}
    assert left == {"month=02", "month=03"}


def test_a_repeated_cycle_gives_the_same_tables(spark, sf_dir, tmp_path):
    flows, limits = frames.delivery_flows(), CycleLimits(lookback_days=3_650, claim=100_000)
    store = delivery_store(spark, str(tmp_path), fan=2)
    add_deliveries(store, frames.deliveries(spark, sf_dir), "orders")
    events, results = frames.stored_events(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir)
    state = ("id", "status", "attempt_count", "lease_token", "next_attempt_at", "state", "error_code")

    def cycle():
        sent = run_cycle(store, events, flows, "c1", frames.DELIVERY_NOW, "w", results, limits)
        return sorted(map(tuple, store.read().select(*state).collect()), key=str), sorted(map(tuple, sent.select("delivery_id", "lease_token", "body").collect()))

    first = cycle()
    assert first[1] and cycle() == first
    opened = store.read(split="open")
    assert {r["state"] for r in opened.select("state").distinct().collect()} == {"open"}
    assert "PartitionFilters: [isnotnull(state" in opened._jdf.queryExecution().toString()


# --- the event ledger --------------------------------------------------------


def events(spark, low, high, flow="f"):
    key = F.sha2(F.concat(F.lit(flow), F.col("id").cast("string")), 256)
    named = spark.range(low, high).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.lit(datetime(2024, 1, 1)).alias("created_at"),
        F.lit(flow).alias("pipeline_id"), key.alias("dedupe_key"), F.lit("{}").alias("payload"),
    )
    nothing = spark.createDataFrame([], EVENT_SCHEMA)
    return nothing.unionByName(named, allowMissingColumns=True)


@pytest.fixture
def ledger(spark, tmp_path):
    made = open_ledger(spark, Ledger(str(tmp_path / "ledger"), f"t{abs(hash(str(tmp_path)))}", buckets=4, fan=2))
    for b in range(9):
        append_events(events(spark, 100 * b, 100 * (b + 1)), made, f"b{b}")
        compact_events(spark, made)
    return made


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_batches_are_merged_and_lookups_stay_the_same(spark, ledger):
    version = ledger.manifest(spark).load()
    assert len(version.entries) <= 4 and sum(e.rows for e in version.entries) == 900
    folders = [n for n in files.names(spark, ledger.path("events")) if n.startswith("batch_id=")]
    assert len(folders) == len(version.entries)
    assert ids(events_of(spark, ledger)) == sorted(f"e{i}" for i in range(900))
    asked = events(spark, 850, 950).unionByName(events(spark, 0, 3, "other"))
    want = events_of(spark, ledger).join(asked.select("pipeline_id", "dedupe_key"), ["pipeline_id", "dedupe_key"], "left_semi")
    assert ids(seen_events(asked, ledger)) == ids(want) == sorted(f"e{i}" for i in range(850, 900))


def test_new_keys_open_a_bounded_share_of_the_files(spark, ledger):
    version = ledger.manifest(spark).load()
    parts = version.parts()
    root = f"{ledger.path('sketches')}/0"
    stored = spark.read.option("basePath", root).parquet(*[f"{root}/batch_id={p}" for p in parts])
    new = events(spark, 5_000, 5_400)
    found = hits(new, stored, ledger.buckets).count()
    assert found <= 4, "about one false hit in 10,000 probes of 400 keys over a few sketches"
    known = hits(events(spark, 0, 900), stored, ledger.buckets)
    assert known.select("dedupe_key").distinct().count() == 900, "a key that is there is never missed"
    assert seen_events(new, ledger).count() == 0
    every = bucket_files(spark, ledger.path("events"), {(p, b) for p in parts for b in range(4)})
    some = bucket_files(spark, ledger.path("events"), {(parts[0], 1)})
    assert len(every) == 4 * len(parts) and len(some) == 1


def test_many_known_keys_meet_the_bucketed_table_without_its_shuffle(spark, ledger, monkeypatch):
    monkeypatch.setattr("sluice.sinks.ledger.keys_fit", lambda n: False)
    asked = events(spark, 0, 900)
    found = seen_events(asked, ledger)
    assert ids(found) == sorted(f"e{i}" for i in range(900))


def test_rebucket_doubles_until_buckets_fit(spark, ledger):
    version = rebucket(spark, ledger, rows_per_bucket=100)
    assert version.layout == 2 and len(version.entries) == 1
    assert rebucket(spark, ledger, rows_per_bucket=100).number == version.number
    assert ids(events_of(spark, ledger)) == sorted(f"e{i}" for i in range(900))
    append_events(events(spark, 900, 950), open_ledger(spark, ledger), "late")
    assert ids(seen_events(events(spark, 890, 960), ledger)) == sorted(f"e{i}" for i in range(890, 950))
    names = files.names(spark, f"{ledger.path('events-2')}/batch_id=late")
    assert len([n for n in names if n.endswith(".parquet")]) == 16


def test_removed_events_are_gone_and_all_others_unchanged(spark, ledger):
    def marks():
        return {r[0]: r[1] for r in events_of(spark, ledger).select("id", F.xxhash64("id", "dedupe_key", "payload", "created_at")).collect()}

    before = marks()
    victims = events(spark, 20, 60)
    assert remove_events(spark, ledger, victims) == 40
    assert remove_events(spark, ledger, victims) == 0
    gone = {f"e{i}" for i in range(20, 60)}
    assert marks() == {k: v for k, v in before.items() if k not in gone}
    assert seen_events(victims, ledger).count() == 0


def test_run_rows_tell_of_their_input(spark, tmp_path):
    spec = frames.poll_flow(dedupe=frames.DedupeSpec(fields=("a",)), filter={}, transform={})
    landed = spark.createDataFrame(
        [(1, 1, frames.NOW, '{"itens":[{"a":1}],"totalRegistros":9}', 200, "https://o.example/?p=1", "t-1", 350)],
        "cycle_id long, page int, fetched_at timestamp, body string, http_status int, url string, trace_id string, elapsed_ms int",
    )
    made = open_ledger(spark, Ledger(str(tmp_path / "l"), "t_about", buckets=2))
    end = frames.NOW + timedelta(seconds=5)
    run_batch(page_documents(landed, spec), spec, made, "b", end)
    row = spark.table(made.table("runs")).first()
    assert (row.request_url, row.body_bytes, row.trace_id, row.duration_ms) == ("https://o.example/?p=1", 38, "t-1", 350)
    assert row.finished_at == end and row.source_ip is None
    policy = policy_frame(spark, [("pipeline_run", 3, 2)])
    assert drop_expired_runs(spark, made, policy, datetime(2024, 3, 1)) == []
    assert drop_expired_runs(spark, made, policy, datetime(2024, 6, 1)) == ["202402"]
    assert spark.table(made.table("runs")).count() == 0 and drop_expired_runs(spark, made, policy, datetime(2024, 6, 1)) == []


# --- metrics -----------------------------------------------------------------


def test_kept_counters_equal_a_recount(spark, tmp_path):
    table = counter_table(spark, str(tmp_path), fan=2)
    schema = "metric string, pipeline_id string, source_kind string, destination_id string, outcome string, reason string, value long"
    batches = [[("g.items.x", f"p{i % 3}", None, None, None, None, i + b) for i in range(6)] for b in range(6)]
    for b in (0, 1, 2, 2, 3, 4, 5, 5):
        add_counters(table, spark.createDataFrame(batches[b], schema).groupBy(*schema.replace(" long", "").replace(" string", "").split(", ")[:-1]).agg(F.sum("value").alias("value")), f"b{b}")
    want: dict = {}
    for row in (r for b in batches for r in b):
        want[row[1]] = want.get(row[1], 0) + row[-1]
    assert {r.pipeline_id: r.value for r in table.read().collect()} == want
    assert len(table.manifest.load().entries) <= 4


def test_merged_quantiles_are_within_the_stated_error(spark, tmp_path):
    table = sketch_table(spark, str(tmp_path), fan=2)
    rows = spark.range(60_000).select(
        F.lit("p").alias("pipeline_id"), (F.xxhash64("id") % 100_000).cast("double").alias("value"),
        F.timestamp_millis(F.col("id") * 400_000).alias("at"),
    )
    for b in range(4):
        table.upsert(f"b{b}", hourly_sketches(rows.where(F.pmod(F.xxhash64("at"), F.lit(4)) == b), "m"))
        table.compact()
    found = quantiles(table.read(), ["pipeline_id"], (0.1, 0.5, 0.99)).first()
    assert found["n"] == 60_000
    for column, share in (("q_10", 0.1), ("q_50", 0.5), ("q_99", 0.99)):
        at = rows.where(F.col("value") <= found[column]).count() / 60_000
        assert abs(at - share) <= 0.0165
