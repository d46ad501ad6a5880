"""Operators on small tables, against plain Python where the shape is made for skew."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import audit, dedupe, delivery, retention
from sluice.operators.skew import PARTS_PER_CORE, attach_by_key, within_first
from sluice.operators.split import split_entries
from sluice.plans import frames
from sluice.plans.intake import dry_run_summary, plan_intake
from sluice.sources.pages import page_documents
from sluice.sources.requests import read_requests, request_documents
from sluice.spec import (
    DedupeSpec,
    DestinationSpec,
    EndpointSource,
    FlowSpec,
    Pagination,
    PollSource,
    RetrySpec,
    SpecError,
    TransformRule,
    compile_filter,
    compile_transform,
)

NOW = datetime(2024, 5, 1, 12)


def poll(**changes) -> FlowSpec:
    given = dict(
        id="pedidos",
        source=PollSource(
            url="https://o.example/p",
            items_path="itens",
            total_count_path="totalRegistros",
            pagination=Pagination(param="p", max_pages=10),
        ),
        dedupe=DedupeSpec(fields=("pedido_id", "situacao")),
        transform={"id": {"from": "pedido_id"}},
        destinations=(DestinationSpec(id="a", url="https://d.example/a"),),
    )
    given.update(changes)
    return FlowSpec(**given)


def endpoint(**changes) -> FlowSpec:
    given = dict(
        id="eventos",
        source=EndpointSource(path="eventos", items_path="eventos"),
        dedupe=DedupeSpec(header="Idempotency-Key", fields=("id",), on_missing="reject"),
        transform={"id": {"from": "id"}},
        destinations=(DestinationSpec(id="a", url="https://d.example/a"),),
    )
    given.update(changes)
    return FlowSpec(**given)


def pages(spark, *rows):
    """rows: (cycle, page, body or (status/net code))."""
    out = []
    for cycle, page, body in rows:
        status, net = 200, None
        if isinstance(body, int):
            status, body = body, None
        elif body in ("ECONNREFUSED",):
            net, body = body, None
        elif not isinstance(body, str):
            body = json.dumps(body)
        at = NOW + timedelta(minutes=int(cycle[1:]), seconds=page)
        out.append((cycle, page, at, body, status, net))
    return spark.createDataFrame(
        out, "cycle_id string, page int, fetched_at timestamp, body string, http_status int, net_code string"
    )


def requests(spark, *rows):
    out = []
    for i, (body, headers) in enumerate(rows):
        out.append((f"r{i}", NOW + timedelta(seconds=i), body if isinstance(body, str) else json.dumps(body), headers))
    return spark.createDataFrame(
        out, "request_id string, received_at timestamp, body string, headers map<string,string>"
    )


def item(n, s="NP", **more):
    return {"pedido_id": n, "situacao": s, **more}


def runs(plan):
    rows = audit.run_rows(plan.outcomes, "POLL").orderBy("created_at").collect()
    return [
        (r.request_page, r.status, r.items_received, r.items_filtered_out, r.items_duplicate, r.items_new, r.deliveries_created)
        for r in rows
    ]


# --- poll flows ------------------------------------------------------------


def test_pages_then_repeat_cycle(spark):
    spec = poll()
    first = pages(
        spark,
        ("c1", 1, {"itens": [item(1), item(2)], "totalRegistros": 3}),
        ("c1", 2, {"itens": [item(3)], "totalRegistros": 3}),
        ("c1", 3, {"itens": [item(9)], "totalRegistros": 3}),
    )
    plan = plan_intake(page_documents(first, spec), spec, NOW)
    assert runs(plan) == [(1, "SUCCESS", 2, 0, 0, 2, 2), (2, "SUCCESS", 1, 0, 0, 1, 1)]
    again = first.withColumn("cycle_id", F.lit("c2")).withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 1 HOUR"))
    repeat = plan_intake(page_documents(again, spec), spec, NOW, plan.events)
    assert [r[4:6] for r in runs(repeat)] == [(2, 0), (1, 0)]
    ids = {r.id for r in plan.events.collect()}
    assert {r.event_id for r in repeat.outcomes.collect()} == ids
    assert repeat.deliveries.count() == 0


def test_stop_rules(spark):
    spec = poll(source=PollSource(url="https://o.example/p", items_path="itens", pagination=Pagination("p", max_pages=3)))
    full = {"itens": [item(1)]}
    kept = page_documents(
        pages(
            spark,
            *[("c1", p, full) for p in (1, 2, 3, 4)],
            ("c2", 1, full),
            ("c2", 2, {"itens": []}),
            ("c2", 3, full),
            ("c3", 1, full),
            ("c3", 2, 502),
            ("c3", 3, full),
            ("c4", 1, "ECONNREFUSED"),
            ("c4", 2, full),
            ("c5", 1, full),
            ("c5", 2, "<html>"),
            ("c5", 3, full),
            ("c6", 1, {"outro": 1}),
            ("c6", 2, full),
        ),
        spec,
    )
    got = sorted((r.ingest_id, r.page, r.error_code) for r in kept.collect())
    assert got == [
        ("c1", 1, None),
        ("c1", 2, None),
        ("c1", 3, None),
        ("c2", 1, None),
        ("c2", 2, None),
        ("c3", 1, None),
        ("c3", 2, "HTTP_502"),
        ("c4", 1, "ECONNREFUSED"),
        ("c5", 1, None),
        ("c5", 2, "INVALID_JSON"),
        ("c6", 1, None),
    ]


def test_no_pagination_reads_one_page(spark):
    spec = poll(source=PollSource(url="https://o.example/p", items_path="itens"))
    kept = page_documents(pages(spark, ("c1", 1, {"itens": [item(1)]}), ("c1", 2, {"itens": [item(2)]})), spec)
    assert [r.page for r in kept.collect()] == [1]


def test_failed_page_gives_an_error_run(spark):
    spec = poll()
    plan = plan_intake(page_documents(pages(spark, ("c1", 1, {"itens": [item(1)]}), ("c1", 2, 500)), spec), spec, NOW)
    assert runs(plan) == [(1, "SUCCESS", 1, 0, 0, 1, 1), (2, "ERROR", 0, 0, 0, 0, 0)]
    result = audit.ingest_result(audit.run_counts(plan.outcomes)).first()
    assert (result.pages, result.accepted) == (1, 1)


def test_partial_leaks_from_earlier_pages(spark):
    spec = poll()
    rows = pages(
        spark,
        ("c1", 1, {"itens": [{"x": 1}]}),
        ("c1", 2, {"itens": [item(1), {"x": 1}]}),
        ("c1", 3, {"itens": [7, None]}),
        ("c2", 1, {"itens": []}),
    )
    plan = plan_intake(page_documents(rows, spec), spec, NOW)
    got = runs(plan)
    # page 3 has no items: it is still kept, and carries the rejects before it
    assert [g[1] for g in got] == ["PARTIAL", "SUCCESS", "PARTIAL", "SUCCESS"]


def test_key_on_two_pages(spark):
    spec = poll()
    rows = pages(spark, ("c1", 1, {"itens": [item(1)]}), ("c1", 2, {"itens": [item(1), item(2)]}))
    plan = plan_intake(page_documents(rows, spec), spec, NOW)
    assert runs(plan) == [(1, "SUCCESS", 1, 0, 0, 1, 1), (2, "SUCCESS", 2, 0, 1, 1, 1)]


def test_intra_batch_repeats(spark):
    spec = poll()
    rows = pages(spark, ("c1", 1, {"itens": [item(1, nth=1), item(1, nth=2), item(1, nth=3)]}))
    plan = plan_intake(page_documents(rows, spec), spec, NOW)
    assert runs(plan) == [(1, "SUCCESS", 3, 0, 0, 1, 1)]
    outcomes = plan.outcomes.orderBy("idx").collect()
    assert [o.status for o in outcomes] == ["accepted"] * 3
    assert len({o.event_id for o in outcomes}) == 1
    assert json.loads(plan.events.first().payload)["nth"] == 1
    keyed = plan.entries.filter(F.col("state") == "keyed")
    assert dedupe.dedupe_batch(keyed).first().surplus == 2
    # the same batch once more: three duplicates of one key
    repeat = plan_intake(page_documents(rows, spec), spec, NOW, plan.events)
    assert runs(repeat)[0][4] == 1 and repeat.outcomes.filter("status = 'duplicate'").count() == 3


def test_routing_follows_the_last_repeat_of_the_run(spark):
    spec = poll(
        dedupe=DedupeSpec(fields=("pedido_id",)),
        destinations=(
            DestinationSpec(id="all", url="https://d.example/a"),
            DestinationSpec(id="some", url="https://d.example/b", filter={"situacao": ["LF"]}),
        ),
    )
    rows = pages(
        spark,
        ("c1", 1, {"itens": [item(1, "NP"), item(1, "LF"), item(2, "LF"), item(2, "NP")]}),
        ("c1", 2, {"itens": [item(1, "XX"), item(2, "LF")]}),
    )
    docs = page_documents(rows, spec)

    def to_some(route_on):
        plan = plan_intake(docs, spec, NOW, route_on=route_on)
        sent = plan.deliveries.filter(F.col("destination_id") == "some")
        sources = plan.events.join(sent, plan.events["id"] == sent["event_id"], "left_semi")
        return [r.dedupe_source for r in sources.collect()]

    assert to_some("last") == ["field:pedido_id=1"]
    assert to_some("first") == ["field:pedido_id=2"]


def test_filters_and_router_together(spark):
    spec = poll(
        filter={"situacao": ["NP", "LF"], "pedido_id": {"numeric": True, "notEquals": 0}},
        destinations=(
            DestinationSpec(id="all", url="https://d.example/a"),
            DestinationSpec(id="one", url="https://d.example/b", filter={"pedido_id": [41655302]}),
        ),
    )
    body = {"itens": [item("41655302"), item(41655303, "LF"), item("0"), item(0), item("abc"), item(5, "XX"), item("7")]}
    docs = page_documents(pages(spark, ("c1", 1, body)), spec)
    plan = plan_intake(docs, spec, NOW)
    assert runs(plan) == [(1, "SUCCESS", 7, 4, 0, 3, 4)]
    by = {r.destination_id: r["count"] for r in plan.deliveries.groupBy("destination_id").count().collect()}
    assert by == {"all": 3, "one": 1}
    summary = dry_run_summary(docs, spec).first()
    assert (summary.received, summary.filtered, summary.no_key_or_transform, summary.ready) == (7, 4, 0, 3)


def test_nul_in_items(spark):
    spec = poll()
    body = '{"itens":[{"pedido_id":"1\\u0000","situacao":"NP","sub":{"k\\u0000":"a\\u0000b"}}]}'
    plan = plan_intake(page_documents(pages(spark, ("c1", 1, body)), spec), spec, NOW)
    event = plan.events.first()
    assert json.loads(event.payload) == {"pedido_id": "1", "situacao": "NP", "sub": {"k": "ab"}}
    assert event.dedupe_source == "field:pedido_id=1|field:situacao=NP"
    assert event.payload_bytes == len(event.payload.encode())


def test_long_key_source_is_cut_but_hashed_whole(spark):
    spec = poll(dedupe=DedupeSpec(fields=("pedido_id",)))
    body = {"itens": [item("x" * 900 + "1"), item("x" * 900 + "2")]}
    plan = plan_intake(page_documents(pages(spark, ("c1", 1, body)), spec), spec, NOW)
    rows = plan.events.collect()
    assert len({r.dedupe_key for r in rows}) == 2 and {len(r.dedupe_source) for r in rows} == {500}


# --- split -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("path", "body", "want"),
    [
        (None, {"a": 1}, [(0, "item", None)]),
        ("x", {"x": [{"a": 1}, 2, {"b": 2}]}, [(0, "item", None), (1, "item", None)]),
        ("x", {"x": {"a": 1}}, [(0, "item", None)]),
        ("x", {"x": []}, [(None, "empty", None)]),
        ("x", {"x": [1, "a"]}, [(None, "empty", None)]),
        ("x", {"x": None}, [(0, "rejected", "itemsPath 'x' ausente no corpo")]),
        ("x", {}, [(0, "rejected", "itemsPath 'x' ausente no corpo")]),
        ("x", {"x": 5}, [(0, "rejected", "itemsPath 'x' nao aponta para objeto ou lista")]),
        ("a.b[0].c", {"a": {"b": [{"c": [{"k": 1}]}]}}, [(0, "item", None)]),
    ],
)
def test_split(spark, path, body, want):
    df = spark.createDataFrame([(json.dumps(body),)], "raw string").select(F.parse_json("raw").alias("doc"))
    got = [(r.idx, r.entry, r.detail) for r in split_entries(df, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_split_numbers_on_through_the_documents_of_a_run(spark):
    rows = [("r", 0, '{"x":[{"a":1},3,{"a":2}]}'), ("r", 1, '{"x":5}'), ("r", 2, '{"x":[{"a":3}]}'), ("s", 0, '{"x":[{"a":4}]}')]
    df = spark.createDataFrame(rows, "run_id string, doc_idx int, raw string").withColumn("doc", F.parse_json("raw"))
    got = split_entries(df, "x").filter("entry = 'item'").orderBy("run_id", "idx").collect()
    assert [(r.run_id, r.idx) for r in got] == [("r", 0), ("r", 1), ("r", 2), ("s", 0)]


# --- endpoint flows --------------------------------------------------------


def responses(spark, spec, *rows, ledger=None):
    docs = request_documents(read_requests(requests(spark, *rows)), spec.id)
    plan = plan_intake(docs, spec, NOW, ledger)
    found = audit.request_response(plan.outcomes).orderBy("ingest_id").collect()
    return plan, found


def test_responses(spark):
    spec = endpoint()
    ok = {"eventos": [{"id": "1"}, {"id": "2"}, {"no": 1}]}
    plan, got = responses(
        spark,
        spec,
        (ok, {}),
        ({"eventos": [{"id": "1"}]}, {}),
        ({"eventos": [{"no": 1}]}, {}),
        ({"eventos": []}, {}),
        ([{"id": "9"}], {}),
        ({"eventos": [{"id": "5"}]}, {"idempotency-KEY": "k1"}),
        ({"eventos": [{"id": "6"}]}, {"Idempotency-Key": "k1"}),
    )
    assert [r.http_status for r in got] == [202, 200, 400, 202, 400, 202, 200]
    first = got[0]
    assert [(i["index"], i.status) for i in first["items"]] == [(0, "accepted"), (1, "accepted"), (2, "rejected")]
    assert first["items"][0].event_id and "header:idempotency-key ou field:id" in first["items"][2].reason
    assert (got[4].received, got[4].rejected, got[4]["items"]) == (0, 1, [])
    assert got[1]["items"][0].event_id == first["items"][0].event_id


def test_filtered_items_are_neither_accepted_nor_rejected(spark):
    spec = endpoint(filter={"id": {"notIn": ["1"]}})
    _, got = responses(spark, spec, ({"eventos": [{"id": "1"}]}, {}))
    assert got[0].http_status == 202 and got[0]["items"][0].status == "filtered"


# --- skew ------------------------------------------------------------------


def test_attach_by_key_with_a_hot_key(spark):
    random.seed(1)
    names = ["hot"] * 4_000 + [f"k{i}" for i in range(6_000)]
    random.shuffle(names)
    rows = spark.createDataFrame([("p", n, i) for i, n in enumerate(names)], "pipeline_id string, dedupe_key string, i int")
    info = rows.groupBy("pipeline_id", "dedupe_key").agg(F.count("i").alias("n_items"), F.min("i").alias("low"))
    info = info.filter(F.col("dedupe_key") != "k7")
    got = attach_by_key(rows, info, ("pipeline_id", "dedupe_key"), ("i",)).collect()
    low = {}
    for i, n in enumerate(names):
        low.setdefault(n, i)
    low["k7"] = None
    assert len(got) == len(names)
    assert all(r.low == low[r.dedupe_key] for r in got)


@pytest.mark.parametrize("limit", [1, 3, 50, 10_000])
def test_within_first_against_brute_force(spark, limit):
    random.seed(limit)
    data = []
    for i in range(5_000):
        group = "hot" if random.random() < 0.4 else f"g{random.randrange(300)}"
        data.append((i, group, random.randrange(40), random.random() < 0.8))
    rows = spark.createDataFrame(data, "i int, g string, at int, ok boolean")
    got = within_first(rows, [F.col("g")], [F.col("at"), F.col("i")], limit, F.col("i"), F.col("ok"), "first")
    by_group = {}
    for i, g, at, ok in data:
        if ok:
            by_group.setdefault(g, []).append((at, i))
    want = {i for members in by_group.values() for _, i in sorted(members)[:limit]}
    assert {r.i for r in got.collect() if r["first"]} == want
    assert got.count() == len(data)


def test_first_occurrences_reduce_before_the_shuffle(spark, sf_dir):
    from sluice.plans.intake import entries

    spec = frames.poll_flow()
    rows = entries(page_documents(frames.landed_pages(spark, sf_dir), spec), spec)
    plan = dedupe.first_occurrences(rows.filter("state = 'keyed'"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("min_by") < plan.index("Exchange hashpartitioning") < plan.index("partial_min_by")


# --- deliveries ------------------------------------------------------------


def one_delivery(spark, **changes):
    given = dict(
        id="d1",
        created_at=NOW,
        pipeline_id="pedidos",
        destination_id="a",
        event_id="e1",
        dedupe_key="k",
        status="PENDING",
        attempt_count=0,
        max_attempts=3,
        next_attempt_at=NOW - timedelta(seconds=120),
    )
    given.update(changes)
    schema = ", ".join(f"{c} {delivery.DELIVERY_COLUMNS[c]}" for c in given)
    return delivery.as_deliveries(spark.createDataFrame([tuple(given.values())], schema))


def outcome(spark, *rows):
    return delivery.as_outcomes(
        spark.createDataFrame(
            [(r.get("id", "d1"), r["token"], r.get("at", NOW), r.get("net"), r.get("status"), r.get("body", ""), r.get("headers")) for r in rows],
            "delivery_id string, lease_token string, finished_at timestamp, net_code string, status int, body string, headers map<string,string>",
        )
    )


FLOW = [poll(destinations=(DestinationSpec(id="a", url="https://d.example/a", retry=RetrySpec(attempts=3, jitter=0)),))]


def test_claim_then_deliver(spark):
    claimed = delivery.claim(one_delivery(spark), NOW, "w", FLOW)
    row = claimed.first()
    assert (row.status, row.attempt_count, row.claimed, row.worker_id) == ("IN_FLIGHT", 1, True, "w")
    assert row.lease_expires_at == NOW + timedelta(seconds=120)
    snapshot = claimed.drop("claimed")
    # a second claim finds the lease held
    assert not delivery.claim(snapshot, NOW, "w2", FLOW).first().claimed
    asked = snapshot.select("id", "created_at")
    assert delivery.claim_miss(snapshot, asked, NOW).first().reason == "LEASE_HELD_BY_OTHER"
    done = delivery.apply_outcomes(snapshot, outcome(spark, {"token": row.lease_token, "status": 200}), NOW, FLOW).first()
    assert (done.status, done.lease_token, done.delivered_at, done.error_code) == ("DELIVERED", None, NOW, None)


def test_expired_lease_is_claimable_and_the_old_result_is_fenced(spark):
    old = one_delivery(spark, status="IN_FLIGHT", attempt_count=1, lease_token="old", lease_expires_at=NOW - timedelta(seconds=1))
    again = delivery.claim(old, NOW, "w2", FLOW).drop("claimed")
    new_token = again.first().lease_token
    assert again.first().attempt_count == 2 and new_token != "old"
    late = outcome(spark, {"token": "old", "status": 200})
    assert delivery.apply_outcomes(again, late, NOW, FLOW).first().status == "IN_FLIGHT"
    assert delivery.duplicate_detected(again, late, NOW, FLOW).count() == 1


def test_second_result_of_one_lease_does_not_count(spark):
    row = one_delivery(spark, status="IN_FLIGHT", attempt_count=1, lease_token="t", lease_expires_at=NOW)
    both = outcome(
        spark,
        {"token": "t", "status": 500, "at": NOW},
        {"token": "t", "status": 200, "at": NOW + timedelta(seconds=1)},
    )
    after = delivery.apply_outcomes(row, both, NOW, FLOW).first()
    assert (after.status, after.next_attempt_at, after.error_code) == ("FAILED", NOW + timedelta(seconds=15), None)
    owned = {(r.http_status, r.owned) for r in delivery.attempt_results(row, both, NOW, FLOW).collect()}
    assert owned == {(500, True), (200, False)}


@pytest.mark.parametrize(
    ("attempt", "result", "want"),
    [
        (1, {"status": 404}, ("DISCARDED", "NON_RETRYABLE_STATUS", "HTTP_404")),
        (3, {"status": 503}, ("DISCARDED", "ATTEMPTS_EXHAUSTED", "HTTP_503")),
        (3, {"net": "ECONNRESET"}, ("DISCARDED", "ATTEMPTS_EXHAUSTED", "ECONNRESET")),
        (1, {"net": "ECONNRESET"}, ("FAILED", None, "ECONNRESET")),
        (1, {"status": 429, "headers": {"retry-after": "7"}}, ("FAILED", None, None)),
    ],
)
def test_outcome_routing(spark, attempt, result, want):
    row = one_delivery(spark, status="IN_FLIGHT", attempt_count=attempt, lease_token="t")
    after = delivery.apply_outcomes(row, outcome(spark, {"token": "t", **result}), NOW, FLOW).first()
    assert (after.status, after.discard_reason, after.error_code) == want
    if "headers" in result:
        assert after.next_attempt_at == NOW + timedelta(seconds=7)


def test_claim_miss_order(spark):
    rows = (
        one_delivery(spark, id="done", status="DELIVERED", attempt_count=3)
        .unionAll(one_delivery(spark, id="spent", attempt_count=3))
        .unionAll(one_delivery(spark, id="free"))
    )
    asked = rows.select("id", "created_at").unionAll(
        spark.createDataFrame([("none", NOW)], "id string, created_at timestamp")
    )
    got = {r.id: r.reason for r in delivery.claim_miss(rows, asked, NOW).collect()}
    assert got == {"done": "ALREADY_TERMINAL", "spent": "ATTEMPTS_EXHAUSTED", "free": None, "none": "NOT_FOUND"}


def test_reap(spark):
    rows = one_delivery(
        spark, id="a", status="IN_FLIGHT", attempt_count=1, lease_token="t", lease_expires_at=NOW - timedelta(minutes=1)
    ).unionAll(
        one_delivery(spark, id="b", status="IN_FLIGHT", attempt_count=3, lease_token="t", lease_expires_at=NOW - timedelta(minutes=1))
    ).unionAll(one_delivery(spark, id="c", status="IN_FLIGHT", attempt_count=1, lease_token="t", lease_expires_at=NOW + timedelta(minutes=1)))
    got = {r.id: (r.status, r.discard_reason, r.error_code, r.attempt_count) for r in delivery.reap(rows, NOW, 90, 100).collect()}
    assert got == {
        "a": ("FAILED", None, "LEASE_EXPIRED", 1),
        "b": ("DISCARDED", "ATTEMPTS_EXHAUSTED", "LEASE_EXPIRED", 3),
        "c": ("IN_FLIGHT", None, None, 1),
    }


def test_drain_only_takes_overdue(spark):
    rows = one_delivery(spark, id="due").unionAll(one_delivery(spark, id="later", next_attempt_at=NOW + timedelta(minutes=10)))
    assert [r.id for r in delivery.drain_candidates(rows, NOW, 60, 90, 10).collect()] == ["due"]


def test_reading_only_the_month_partitions_needed(spark, tmp_path):
    from sluice.sinks.ledger import with_delivery_partitions

    rows = one_delivery(spark, id="new").unionAll(one_delivery(spark, id="old", created_at=NOW - timedelta(days=200)))
    path = str(tmp_path / "d")
    with_delivery_partitions(rows).write.partitionBy("created_month").parquet(path)
    due = delivery.drain_candidates(spark.read.parquet(path), NOW, 60, 30, 10)
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan
    assert [r.id for r in due.collect()] == ["new"]


def test_body_retention(spark):
    rows = spark.createDataFrame([("TRUNCATED",), ("FULL",), ("HASH_ONLY",)], "persist_body string").withColumns(
        {"request_body": F.repeat(F.lit("x"), 20_000), "response_body": F.repeat(F.lit("y"), 20_000), "error_message": F.repeat(F.lit("e"), 5_000)}
    )
    got = {r.persist_body: r for r in delivery.retain_body(rows).collect()}
    assert got["TRUNCATED"].request_body == "x" * 8192 + "...[truncado]"
    assert got["TRUNCATED"].response_body == "y" * 4096 + "...[truncado]"
    assert len(got["FULL"].request_body) == 20_000 and got["HASH_ONLY"].request_body is None
    assert {r.request_body_bytes for r in got.values()} == {20_000}
    assert {len(r.error_message) for r in got.values()} == {2_000}


def test_rendering_uses_the_spec_of_the_moment(spark):
    events = spark.createDataFrame(
        [("e1", NOW, "pedidos", "k", '{"pedido_id":"x1"}')],
        "id string, created_at timestamp, pipeline_id string, dedupe_key string, payload string",
    )
    row = one_delivery(spark, status="IN_FLIGHT", attempt_count=2)
    strict = [poll(transform={"id": {"from": "pedido_id", "cast": "number"}})]
    bad = delivery.render_requests(row, events, strict).first()
    assert (bad.body, bad.err_reason) == (None, "TRANSFORM_FAILED")
    good = delivery.render_requests(row, events, [poll()]).first()
    assert good.body == '{"id":"x1"}' and good.headers["x-delivery-attempt"] == "2" and good.headers["idempotency-key"] == "d1"


# --- retention -------------------------------------------------------------


def test_purge_keeps_events_with_open_deliveries(spark):
    old = NOW - timedelta(days=100)
    events = spark.createDataFrame(
        [(f"e{i}", old + timedelta(hours=i), "p", f"k{i}") for i in range(5)],
        "id string, created_at timestamp, pipeline_id string, dedupe_key string",
    )
    rows = one_delivery(spark, id="x", event_id="e1", created_at=old + timedelta(hours=1)).unionAll(
        one_delivery(spark, id="y", event_id="e2", created_at=old + timedelta(hours=2), status="DELIVERED")
    )
    got = sorted(r.id for r in retention.purge_candidates(events, rows, NOW, 90, 3).collect())
    assert got == ["e0", "e2"]


def test_policy_keeping_everything(spark):
    policy = retention.policy_frame(spark, [("pipeline_run", 3, 0)])
    months = spark.createDataFrame([("pipeline_run", "199901", 1)], "table_name string, month string, n_rows long")
    assert retention.partitions_expired(policy, months, NOW).count() == 0


# --- specs -----------------------------------------------------------------


@pytest.mark.parametrize(
    "build",
    [
        lambda: poll(dedupe=DedupeSpec(header="X")),
        lambda: poll(dedupe=DedupeSpec()),
        lambda: endpoint(dedupe=DedupeSpec(fields=("id",))),
        lambda: endpoint(source=EndpointSource(path="metrics/x")),
        lambda: endpoint(source=EndpointSource(path="a//b")),
        lambda: poll(destinations=()),
        lambda: poll(destinations=(DestinationSpec(id="a", url="u"), DestinationSpec(id="a", url="v"))),
        lambda: compile_filter({"a": []}),
        lambda: compile_filter({"a": {}}),
        lambda: compile_filter({"a.__proto__": [1]}),
        lambda: compile_transform({"a": TransformRule(source="x", cast="money")}),
        lambda: compile_transform({"a": {"const": 1, "from": "x"}}),
        lambda: compile_transform({"a": {"const": 1, "default": 2}}),
        lambda: RetrySpec(attempts=0),
        lambda: Pagination("p", max_pages=1_001),
    ],
)
def test_bad_specs(build):
    with pytest.raises(SpecError):
        build()


def test_spec_forms(spark):
    assert compile_filter({"a": [1]}) == compile_filter({"a": {"in": [1]}})
    assert compile_filter({"a": {"numeric": False}})[0].predicates == ()
    kinds = [k for k, _ in compile_filter({"a": {"exists": True, "in": [1], "numeric": True}})[0].predicates]
    assert kinds == ["in", "numeric", "exists"]
    assert [d for d, _ in compile_transform({"b": {"const": 1}, "a.z": {"const": 1}})] == ["a.z", "b"]
    assert DestinationSpec(id="a", url="u", timeout_ms=5_000).lease_seconds == 45
    assert EndpointSource(path="/in/a-b/").route == "/in/a-b"
    twins = [poll(id="one"), poll(id="two")]
    found = audit.double_delivery(spark, [*twins, poll(id="three", enabled=False)]).collect()
    assert [(r.request_url, r.n_pipelines) for r in found] == [("https://d.example/a", 2)]


def test_run_counts_of_entries_equal_those_of_outcomes(spark, sf_dir):
    from sluice.operators.audit import run_counts, run_counts_of_entries
    from sluice.plans.queries_intake import intake, ledger

    plan = intake(spark, sf_dir)
    columns = sorted(run_counts(plan.outcomes).columns)
    got = run_counts_of_entries(plan.entries, ledger(spark, sf_dir))
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, run_counts(plan.outcomes).select(columns).collect()), key=str)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routing_of_attempts_shuffles_no_bodies(spark, sf_dir):
    routed = delivery.attempt_results(frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir), NOW, frames.delivery_flows())
    sent = _plan(routed).split("Exchange hashpartitioning")[0]
    assert "_tie" in sent and "request_body" not in sent and "net_message" not in sent


def test_bodies_are_grouped_in_many_small_parts(spark, sf_dir):
    parts = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    after = delivery.apply_outcomes(frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir), NOW, frames.delivery_flows())
    assert f", {parts}), REPARTITION_BY_NUM" in _plan(after)


def test_results_of_no_held_lease_go_before_the_sort(spark, sf_dir):
    row = one_delivery(spark, status="IN_FLIGHT", attempt_count=1, lease_token="t")
    twice = outcome(spark, {"token": "x", "status": 500}, {"token": "t", "status": 204}, {"token": "t", "status": 204})
    held = delivery.held_results(row, twice).collect()
    assert [(r.lease_token, r.r.status) for r in held] == [("t", 204)]
    assert delivery.apply_outcomes(row, twice, NOW, FLOW).first().status == "DELIVERED"
    rows, results = frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir)
    sorted_after = _plan(delivery.apply_outcomes(rows, results, NOW, frames.delivery_flows())).rsplit("Sort [delivery_id", 1)[1]
    assert "ShuffledHashJoin" in sorted_after and "LeftSemi" in sorted_after


def test_pages_are_dealt_by_cycle_before_their_bodies_are_parsed(spark):
    parts = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    full, cut = {"itens": [item(1), item(2)], "totalRegistros": 5}, {"itens": [item(3)]}
    landed = pages(
        spark,
        *[("c1", p, full) for p in (1, 2, 3, 4)],
        *[("c2", p, cut) for p in (1, 2)],
        ("c2", 3, 500),
        ("c2", 4, cut),
        *[("c3", p, {"itens": [item(4)][: p != 2]}) for p in (1, 2, 3)],
    )
    kept = page_documents(landed, poll())
    found = {(r.ingest_id, r.page, r.error_code) for r in kept.collect()}
    assert found == {*(("c1", p, None) for p in (1, 2, 3)), ("c2", 1, None), ("c2", 2, None), ("c2", 3, "HTTP_500"), ("c3", 1, None), ("c3", 2, None)}
    lines = [x.strip(" +-:") for x in _plan(kept).splitlines()]
    dealt = next(i for i, x in enumerate(lines) if x.startswith("Exchange"))
    assert f", {parts}), REPARTITION_BY_NUM" in lines[dealt] and "from_json" in "".join(lines[:dealt])


def test_outcomes_of_an_intake_hold_no_contents(spark, sf_dir):
    spec = frames.endpoint_flow()
    docs = request_documents(read_requests(frames.landed_requests(spark, sf_dir)), spec.id)
    made = plan_intake(docs, spec, NOW)
    assert "AS payload" not in _plan(made.outcomes) and "AS payload" in _plan(made.events)
    assert "distinct" not in _plan(audit.request_response(made.outcomes))


def test_a_batch_of_attempts_is_chosen_before_the_shuffle(spark, sf_dir):
    routed = delivery.attempt_results(frames.deliveries(spark, sf_dir), frames.attempt_outcomes(spark, sf_dir), NOW, frames.delivery_flows())
    chosen = routed.filter(F.substring("delivery_id", 2, 30).cast("bigint") % 5 == 4)
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "% 5) = 4" in plan.replace("cast(substring", "").rsplit("Window [", 1)[1]
