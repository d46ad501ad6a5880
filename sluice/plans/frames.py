"""Inputs of the registered queries, derived from the given tables by Spark.

Pages and requests are made of `events`, deliveries and attempt results of
`orders`. Every row of the tables is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.intake import shared_folder
from sluice.session import configure
from sluice.sinks import files
from sluice.sources.spread import spread
from sluice.spec import (
    DedupeSpec,
    DestinationSpec,
    EndpointSource,
    FlowSpec,
    Pagination,
    PollSource,
    RetrySpec,
)

PAGE_SIZE = 100
PAGES_PER_CYCLE = 10
REQUEST_SIZE = 5
NOW = datetime(2024, 2, 1)
PURGED_BEFORE = datetime(1995, 6, 1)
DELIVERY_NOW = datetime(2001, 8, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the tables of one query, below `spark.checkpoint.dir`; removed when Python ends."""
    local = f"file://{tempfile.gettempdir()}/sluice-work" if spark.sparkContext.master.startswith("local[") else None
    folder = f"{shared_folder(spark, local)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            files.remove(spark, folder)

    atexit.register(clean)
    return folder


def utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


def millis(column: Column | str) -> Column:
    return F.unix_millis(column)


def item_json() -> Column:
    """One event as a JSON item whose `code`, `note` and `flag` vary in type and presence."""
    n = F.col("event_id")
    note = (
        F.when(n % 5 == 1, ',"note":null')
        .when(n % 5 == 2, ',"note":""')
        .when(n % 5 == 3, F.concat(F.lit(',"note":"  n'), F.col("user_id").cast("string"), F.lit(' "')))
        .when(n % 5 == 4, ',"note":"Nota"')
        .otherwise("")
    )
    code = F.when(n % 2 == 0, F.col("user_id").cast("string")).otherwise(
        F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))
    )
    flag = F.when(n % 3 == 0, "true").when(n % 3 == 1, '"sim"').otherwise('"x"')
    return F.concat(
        F.lit('{"type":"'),
        F.col("event_type"),
        F.lit('","event_id":'),
        n.cast("string"),
        F.lit(',"code":'),
        code,
        F.lit(',"value":'),
        F.col("value").cast("string"),
        F.lit(',"at":"'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","props":'),
        F.col("props"),
        F.lit(',"flag":'),
        flag,
        note,
        F.lit("}"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a parsed item."""
    events = table(spark, sf_dir, "events")
    raw = events.select("event_id", "user_id", "event_type", "value", "ts", item_json().alias("raw"))
    return raw.withColumn("item", F.parse_json("raw"))


def _bodies(events: DataFrame, *keys: Column) -> DataFrame:
    """Items joined per key in event order; each key holds a fixed number of events."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", item_json().alias("j"))))
    grouped = events.groupBy(*keys).agg(rows.alias("rows"), F.min("ts").cast("timestamp").alias("first_ts"))
    return grouped.withColumn("items", F.array_join(F.transform("rows", lambda r: r["j"]), ","))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 events a page, 10 pages a cycle; a scalar and a null stand among the items.

    Some cycles have a page that failed with HTTP 503, a page that is not JSON, a
    page without items, or a declared total that is reached early.
    """
    n = F.col("event_id")
    pages = _bodies(
        table(spark, sf_dir, "events"),
        F.floor(n / (PAGE_SIZE * PAGES_PER_CYCLE)).alias("cycle_id"),
        (F.floor(n / PAGE_SIZE) % PAGES_PER_CYCLE + 1).cast("int").alias("page"),
    )
    cycle = F.col("cycle_id")
    empty = (cycle % 6 == 4) & (F.col("page") == 8)
    total = F.when(cycle % 4 == 1, "700").otherwise("1000")
    body = F.concat(
        F.lit('{"itens":[7,'),
        F.when(empty, "3").otherwise(F.col("items")),
        F.lit(',null],"totalRegistros":'),
        total,
        F.lit("}"),
    )
    broken = (cycle % 5 == 3) & (F.col("page") == 6)
    at = F.timestamp_micros(
        F.unix_micros(F.lit(NOW)) + (F.col("cycle_id") * 60 + F.col("page")) * 1_000_000
    )
    return pages.select(
        "cycle_id",
        "page",
        at.alias("fetched_at"),
        F.when(broken, F.concat(body, F.lit("}"))).otherwise(body).alias("body"),
        F.when((F.col("cycle_id") % 7 == 2) & (F.col("page") == 4), 503).otherwise(200).alias("http_status"),
    )


def poll_flow(**changes) -> FlowSpec:
    given = dict(
        id="coleta",
        source=PollSource(
            url="https://origin.example/itens",
            pagination=Pagination(param="pagina", max_pages=50),
            items_path="itens",
            total_count_path="totalRegistros",
        ),
        filter={"type": ["click", "purchase"], "code": {"numeric": True, "notEquals": 0}},
        dedupe=DedupeSpec(fields=("code", "type", "props.k")),
        transform={
            "evento.id": {"from": "event_id", "cast": "integer"},
            "evento.tipo": {"from": "type", "cast": "upper"},
            "codigo": {"from": "code", "cast": "number"},
            "nota": {"from": "note", "cast": "trim"},
            "k": {"from": "props.k"},
            "origem": {"const": "poll"},
        },
        destinations=(
            DestinationSpec(id="todos", url="https://dest.example/todos?token=abc&x=1"),
            DestinationSpec(
                id="compras",
                url="https://dest.example/compras",
                filter={"type": ["purchase"]},
                retry=RetrySpec(attempts=3),
            ),
        ),
    )
    given.update(changes)
    return FlowSpec(**given)


def landed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 events a request. Bodies are broken, arrays or objects; headers, routes and methods vary."""
    r = F.floor(F.col("event_id") / REQUEST_SIZE)
    requests = _bodies(table(spark, sf_dir, "events"), r.alias("request_id"))
    n = F.col("request_id")
    text = n.cast("string")
    body = (
        F.when(n % 17 == 3, F.concat(F.lit('{"eventos":['), F.col("items")))
        .when(n % 17 == 5, F.concat(F.lit("["), F.col("items"), F.lit("]")))
        .otherwise(F.concat(F.lit('{"eventos":['), F.col("items"), F.lit("]}")))
    )
    headers = F.when(
        n % 6 == 0,
        F.create_map(
            F.lit("Content-Type"),
            F.lit("application/json"),
            F.lit("Idempotency-Key"),
            F.concat(F.lit("k-"), F.floor(n / 12).cast("string")),
        ),
    ).otherwise(F.create_map(F.lit("Content-Type"), F.lit("application/json")))
    path = F.when(n % 13 == 4, "/in/outra").when(n % 13 == 6, "/IN/Eventos//").otherwise("/in/eventos")
    return requests.select(
        "request_id",
        F.col("first_ts").alias("received_at"),
        body.alias("body"),
        headers.alias("headers"),
        path.alias("path"),
        F.when(n % 19 == 7, "get").otherwise("post").alias("method"),
        (n % 11 != 0).alias("authorized"),
        F.concat(F.lit("10.0.0."), (n % 250).cast("string")).alias("source_ip"),
    )


def endpoint_flow(**changes) -> FlowSpec:
    given = dict(
        id="recepcao",
        source=EndpointSource(
            path="eventos", items_path="eventos", max_body_bytes=720, rate_per_minute=2
        ),
        filter={"type": {"notIn": ["error"]}},
        dedupe=DedupeSpec(header="Idempotency-Key", fields=("code", "type", "note"), on_missing="reject"),
        transform={"id": {"from": "event_id"}},
        destinations=(DestinationSpec(id="unico", url="https://dest.example/unico"),),
    )
    given.update(changes)
    return FlowSpec(**given)


def delivery_flows() -> list[FlowSpec]:
    """Flows p0 and p1 (p2 is unknown); p1 lost its destination d1."""

    def flow(name: str, *destinations: DestinationSpec) -> FlowSpec:
        return FlowSpec(
            id=name,
            source=PollSource(url="https://origin.example/o", items_path="itens"),
            dedupe=DedupeSpec(fields=("o_orderkey",)),
            transform={
                "pedido": {"from": "o_orderkey", "cast": "string"},
                "estado": {"from": "o_orderstatus", "cast": "lower"},
                "prioridade.nivel": {"from": "nivel", "cast": "integer"},
                "cliente": {"from": "o_custkey"},
            },
            destinations=destinations,
        )

    plain = RetrySpec(jitter=0)
    return [
        flow(
            "p0",
            DestinationSpec(id="d0", url="https://d.example/0", retry=plain),
            DestinationSpec(
                id="d1",
                url="https://d.example/1",
                timeout_ms=5_000,
                success_statuses=(200, 404),
                persist_body="HASH_ONLY",
                headers={"accept": "text/plain", "x-origem": "p0"},
                retry=RetrySpec(jitter=0, backoff="fixed", initial_delay_ms=1_000),
            ),
        ),
        flow("p1", DestinationSpec(id="d0", url="https://d.example/2", persist_body="FULL", retry=plain)),
    ]


def _hours(n: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(utc("o_orderdate")) + n * 3_600_000_000)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a delivery; state, attempts and lease follow from its key."""
    from sluice.operators.delivery import as_deliveries

    n, m = F.col("o_orderkey"), F.col("o_custkey")
    text = n.cast("string")
    status = (
        F.when(n % 5 == 0, "PENDING")
        .when(n % 5 == 1, "IN_FLIGHT")
        .when(n % 5 == 2, "FAILED")
        .when(n % 5 == 3, "DELIVERED")
        .otherwise("DISCARDED")
    )
    in_flight = n % 5 == 1
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), text).alias("id"),
        utc("o_orderdate").alias("created_at"),
        F.concat(F.lit("p"), (m % 3).cast("string")).alias("pipeline_id"),
        F.concat(F.lit("d"), (n % 2).cast("string")).alias("destination_id"),
        F.concat(F.lit("e"), text).alias("event_id"),
        F.sha2(F.concat(F.lit("field:o_orderkey="), text), 256).alias("dedupe_key"),
        status.alias("status"),
        (n % 4).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        _hours(n % 7).alias("next_attempt_at"),
        F.when(in_flight, F.concat(F.lit("t"), text)).alias("lease_token"),
        F.when(in_flight, _hours(n % 48)).alias("lease_expires_at"),
        F.when(n % 3 == 0, F.lit("ECONNRESET")).alias("error_code"),
        F.lit("POST").alias("request_method"),
        F.concat(F.lit("https://d.example/"), (m % 3).cast("string")).alias("request_url"),
    )
    return as_deliveries(rows)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events behind `deliveries`, those of the first months purged."""
    n = F.col("o_orderkey")
    level = F.substring("o_orderpriority", 1, 1)
    shown = F.when(n % 10 == 9, F.concat(F.lit("n"), level)).otherwise(level)
    payload = F.concat(
        F.lit('{"nivel":"'),
        shown,
        F.lit('","o_custkey":'),
        F.col("o_custkey").cast("string"),
        F.lit(',"o_orderkey":'),
        n.cast("string"),
        F.lit(',"o_orderstatus":"'),
        F.col("o_orderstatus"),
        F.lit('"}'),
    )
    text = n.cast("string")
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderdate") >= F.lit(PURGED_BEFORE))
        .select(
            F.concat(F.lit("e"), text).alias("id"),
            utc("o_orderdate").alias("created_at"),
            F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("pipeline_id"),
            F.sha2(F.concat(F.lit("field:o_orderkey="), text), 256).alias("dedupe_key"),
            payload.alias("payload"),
        )
    )


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for every order; every 13th carries a lease of its own."""
    from sluice.operators.delivery import as_outcomes

    n = F.col("o_orderkey")
    text = n.cast("string")
    codes = F.array(*[F.lit(c) for c in (200, 204, 301, 404, 408, 429, 500, 100)])
    net = n % 9 == 8
    wait = F.when(n % 4 == 0, "120").when(n % 4 == 1, "Thu, 02 Aug 2001 00:10:00 GMT").when(n % 4 == 2, "soon")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), text).alias("delivery_id"),
        F.when(n % 13 == 0, F.concat(F.lit("x"), text)).otherwise(F.concat(F.lit("t"), text)).alias("lease_token"),
        utc("o_orderdate").alias("finished_at"),
        F.when(net, "ETIMEDOUT").alias("net_code"),
        F.when(net, "timed out").alias("net_message"),
        F.when(~net, F.get(codes, (n % 9).cast("int"))).alias("status"),
        F.when(~net & wait.isNotNull(), F.create_map(F.lit("retry-after"), wait)).alias("headers"),
        F.when(~net, F.repeat(F.lit("r"), (n % 5_000).cast("int"))).alias("body"),
        F.concat(F.lit('{"pedido":"'), text, F.lit('"}')).alias("request_body"),
        (n % 700).cast("int").alias("duration_ms"),
    )
    return as_outcomes(rows)
