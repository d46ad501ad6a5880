"""Table-driven cases for the column functions."""

from __future__ import annotations

import hashlib

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.functions import redact, retry, variants
from sluice.functions.dates import month_partition, resolve_date_template
from sluice.functions.predicates import predicate
from sluice.functions.reshape import apply_transform
from sluice.functions.variants import (
    Value,
    canonical_json,
    double_text,
    fence,
    parse_body,
    parse_path,
    path_get,
    strip_nul,
    wrap_body,
)
from sluice.operators.keys import with_dedupe_key
from sluice.spec import DedupeSpec, compile_transform


def docs(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "i int, raw string").withColumn("doc", F.parse_json("raw"))


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


# --- parsing ---------------------------------------------------------------


@pytest.mark.parametrize(
    ("path", "segments"),
    [("a.b", ["a", "b"]), ("a[0].b", ["a", "0", "b"]), ("a.0.b", ["a", "0", "b"]), ("a[1][2]", ["a", "1", "2"])],
)
def test_parse_path(path, segments):
    assert parse_path(path) == segments


def test_parse_body_takes_exactly_one_value(spark):
    cases = [
        ('{"a":1}', '{"a":1}'),
        (" [1] ", "[1]"),
        ("null", "null"),
        ('"x"', '"x"'),
        ("", None),
        ("{} {}", None),
        ('{"a":1}}', None),
        ("[1]]", None),
        ("1,2", None),
        ('{"a":1}] {"b":2}', None),
        ('{"a":', None),
        ("01", None),
        ("NaN", None),
        ('{"a":1,"a":2}', '{"a":2}'),
        ('"a\0"', None),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, raw string")
    got = values(df.withColumn("j", F.to_json(parse_body(F.col("raw")))), "j")
    assert got == [want for _, want in cases]


def test_wrap_body(spark):
    df = docs(spark, {"a": 1}, [1, 2], "7", '"t"', "null")
    assert values(df.withColumn("j", F.to_json(wrap_body(F.col("doc")))), "j") == [
        '{"a":1}',
        '{"value":[1,2]}',
        '{"value":7}',
        '{"value":"t"}',
        '{"value":null}',
    ]


def test_strip_nul_only_touches_real_escapes(spark):
    df = spark.createDataFrame(
        [
            (0, r'{"a\u0000b":"x\u0000\u0000y"}'),
            (1, r'{"a":"keep \\u0000 text"}'),
            (2, r'{"a":"\\\u0000"}'),
            (3, r'{"a\u0000":1,"a":2}'),
        ],
        "i int, raw string",
    )
    got = values(df.withColumn("j", F.to_json(F.parse_json(strip_nul(F.col("raw"))))), "j")
    assert [json.loads(g) for g in got] == [{"ab": "xy"}, {"a": "keep \\u0000 text"}, {"a": "\\"}, {"a": 2}]


def test_path_get(spark):
    df = docs(spark, {"a": [{"b": 5}], "o": {"0": "zero", "n": None, "it's": 1}, "constructor": {"x": 1}, "s": 3})
    cases = {
        "a[0].b": "5",
        "a.0.b": "5",
        "o.0": '"zero"',
        "o.n": "null",
        "o.n.x": None,
        "s.x": None,
        "a.b": None,
        "a[7]": None,
        "o.it's": "1",
        "constructor.x": None,
        "o.__proto__": None,
    }
    row = df.select(*[F.to_json(path_get(F.col("doc"), p)).alias(f"c{i}") for i, p in enumerate(cases)]).first()
    assert list(row) == list(cases.values())


def test_canonical_json_sorts_by_utf16_units(spark):
    df = docs(spark, '{"b":[3,{"z":1,"y":2}],"a":1.0}', '{"�":1,"\U0001f600":2}')
    assert values(df.withColumn("j", canonical_json(F.col("doc"))), "j") == [
        '{"a":1,"b":[3,{"y":2,"z":1}]}',
        '{"\U0001f600":2,"�":1}',
    ]


def test_double_text(spark):
    cases = {
        0.0: "0",
        -0.0: "0",
        1.0: "1",
        -2.5: "-2.5",
        0.1: "0.1",
        1e3: "1000",
        1e-6: "0.000001",
        1.5e-7: "1.5e-7",
        1e21: "1e+21",
        1.5e22: "1.5e+22",
        123456789012345680000.0: "123456789012345680000",
        1e20: "100000000000000000000",
        0.000123: "0.000123",
        9007199254740993.0: "9007199254740992",
        1e-10: "1e-10",
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v double")
    assert values(df.withColumn("t", double_text(F.col("v"))), "t") == list(cases.values())


def test_filters_stay_above_a_fence(spark):
    df = docs(spark, {"a": 1}, {"a": 2})
    bound = fence(df, {"x": path_get(F.col("doc"), "a")}).filter(F.to_json("x") == "1")
    plan = bound._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate inline") and plan.count("Filter") == 1
    assert values(bound, "i") == [0]


# --- predicates ------------------------------------------------------------

_X = object()


@pytest.mark.parametrize(
    ("kind", "argument", "cases"),
    [
        (
            "numeric",
            True,
            [(42, True), ("884512", True), ("0", True), ("abc", False), ("", False), ("  ", False), (True, False), (None, False), (_X, False), ("0x1f", True), (" 1e3 ", True), ("1d", False), ("NaN", False), ("Infinity", False), ([1], False)],
        ),
        ("notEquals", 0, [(0, False), (884512, True), ("0", False), ("abc", True), (None, False), (_X, False), ({"a": 1}, False), ([], False)]),
        ("exists", True, [("ABC", True), (None, False), (_X, False), ([], True), ({}, True), (False, True)]),
        ("exists", False, [("ABC", False), (None, True), (_X, True), ([], False)]),
        ("notIn", ["CANC", "EXC"], [("NP", True), ("CANC", False), (None, False), (_X, False), ([], False), (5, True)]),
        ("equals", "PF", [("PF", True), ("SL", False), ("pf", False)]),
        ("in", [10], [("10", True), (10, True), ("10.0", True), (" 10 ", True), ("1e1", True), (11, False), (True, False)]),
        ("in", ["10"], [("10", True), (10, True), ("10.0", False), (10.0, True)]),
        ("in", [True], [("true", False), (1, False), (True, True), (False, False)]),
        ("in", [None, "x"], [(None, False), ("x", True), (_X, False)]),
        ("in", [None], [(None, False), ("", False)]),
    ],
)
def test_predicates(spark, kind, argument, cases):
    df = docs(spark, *[{} if v is _X else {"f": v} for v, _ in cases])
    got = values(df.withColumn("k", predicate(Value.of(path_get(F.col("doc"), "f")), kind, argument)), "k")
    assert got == [want for _, want in cases]


# --- keys ------------------------------------------------------------------


def keys_of(df, spec):
    keyed = with_dedupe_key(df, spec, "doc").orderBy("i")
    return [(r.dedupe_source, r.dedupe_key) for r in keyed.collect()]


def test_composite_key_needs_all_parts(spark):
    df = docs(spark, {"n": 884512, "s": "LF"}, {"n": "884512", "s": "LF"}, {"n": 1}, {"n": 1, "s": ""}, {"n": {"x": 1}, "s": "LF"}, {"n": True, "s": 1e21})
    got = keys_of(df, DedupeSpec(fields=("n", "s")))
    assert got[0][0] == "field:n=884512|field:s=LF" and len(got[0][1]) == 64
    assert got[0] == got[1]
    assert got[2:5] == [(None, None)] * 3
    assert got[5][0] == "field:n=true|field:s=1e+21"


def test_header_first_then_fields(spark):
    rows = [
        (0, '{"n":1}', {"x-id": "h1"}, "endpoint"),
        (1, '{"n":1}', {"x-id": ""}, "endpoint"),
        (2, '{"n":1}', None, "endpoint"),
        (3, '{"n":1}', {"x-id": "h1"}, "poll"),
        (4, "{}", None, "endpoint"),
    ]
    df = spark.createDataFrame(rows, "i int, raw string, headers map<string,string>, origin_kind string")
    df = df.withColumn("doc", F.parse_json("raw"))
    got = [s for s, _ in keys_of(df, DedupeSpec(header="X-Id", fields=("n",), on_missing="reject"))]
    assert got == ["header:x-id=h1", "field:n=1", "field:n=1", "field:n=1", None]


def test_generated_key_ignores_member_order(spark):
    df = docs(spark, '{"a":"x","b":1}', '{"b":1,"a":"x"}', '{"a":"x","b":2}')
    got = keys_of(df, DedupeSpec(fields=("missing",), on_missing="generate"))
    assert got[0] == got[1] != got[2]
    assert got[0][0].startswith("sha256(item)=")


# --- transform -------------------------------------------------------------


def rendered(spark, rules, *bodies):
    out = apply_transform(docs(spark, *bodies), compile_transform(rules)).orderBy("i").collect()
    return [(r.body, r.problem) for r in out]


@pytest.mark.parametrize(
    ("cast", "value", "want"),
    [
        ("number", "884512", "884512"),
        ("number", " 12.50 ", "12.5"),
        ("number", "", "0"),
        ("number", True, "1"),
        ("number", "0x10", "16"),
        ("number", 1.0, "1"),
        ("number", "1e21", "1e+21"),
        ("integer", "7", "7"),
        ("integer", 7.0, "7"),
        ("boolean", "sim", "true"),
        ("boolean", "NAO", "false"),
        ("boolean", "0", "false"),
        ("boolean", 1, "true"),
        ("boolean", False, "false"),
        ("upper", "abc", '"ABC"'),
        ("lower", "ABC", '"abc"'),
        ("trim", "  x\t", '"x"'),
        ("string", 5, '"5"'),
        ("string", True, '"true"'),
        ("string", 'q"', '"q\\""'),
        ("iso-date", 0, '"1970-01-01T00:00:00.000Z"'),
        ("iso-date", "2024-02-29", '"2024-02-29T00:00:00.000Z"'),
        ("iso-date", "2024-02-29T10:00:00-03:00", '"2024-02-29T13:00:00.000Z"'),
        ("iso-date", "2024-02-29 10:00:00", '"2024-02-29T10:00:00.000Z"'),
        ("epoch-millis", "1970-01-01T00:00:01.500Z", "1500"),
        ("epoch-millis", 12.9, "12"),
    ],
)
def test_casts(spark, cast, value, want):
    assert rendered(spark, {"x": {"from": "v", "cast": cast}}, {"v": value}) == [(f'{{"x":{want}}}', None)]


@pytest.mark.parametrize(
    ("cast", "value", "why"),
    [
        ("number", "abc", "valor 'abc' nao e numero"),
        ("number", "1d", "valor '1d' nao e numero"),
        ("number", {"a": 1}, "valor '[object Object]' nao e numero"),
        ("integer", 1.5, "valor '1.5' nao e inteiro"),
        ("boolean", " sim", "valor ' sim' nao e booleano"),
        ("iso-date", "ontem", "valor 'ontem' nao e data"),
        ("epoch-millis", 1e300, "valor '1e+300' nao e data"),
        ("string", [1], "valor nao escalar para cast string"),
    ],
)
def test_failing_casts(spark, cast, value, why):
    assert rendered(spark, {"x": {"from": "v", "cast": cast}}, {"v": value}) == [(None, f"campo 'v': {why}")]


def test_transform_shapes(spark):
    rules = {
        "b.c": {"from": "missing"},
        "b.d": {"from": "n", "default": "none"},
        "a": {"from": "obj"},
        "z.y.x": {"from": "missing"},
        "k": {"const": None},
        "9": {"const": 1},
    }
    assert rendered(spark, rules, {"obj": {"q": [1]}}, {"n": 0, "obj": None}) == [
        ('{"9":1,"a":{"q":[1]},"b":{"d":"none"},"k":null}', None),
        ('{"9":1,"b":{"d":0},"k":null}', None),
    ]
    assert rendered(spark, {"x": {"from": "missing"}}, {}) == [("{}", None)]


def test_a_leaf_and_members_on_one_path(spark):
    rules = {"a": {"from": "v"}, "a.b": {"from": "w"}}
    assert rendered(spark, rules, {"v": 1, "w": 2}, {"v": {"q": 1, "b": 0}, "w": 2}, {"v": 1}, {"w": 2}) == [
        ('{"a":{"b":2}}', None),
        ('{"a":{"q":1,"b":2}}', None),
        ('{"a":1}', None),
        ('{"a":{"b":2}}', None),
    ]


def test_first_failing_rule_in_path_order_is_reported(spark):
    rules = {"b": {"from": "x", "cast": "number"}, "a": {"from": "y", "cast": "boolean"}}
    assert rendered(spark, rules, {"x": "?", "y": "?"})[0][1] == "campo 'y': valor '?' nao e booleano"


# --- retry -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("net", "status", "listed", "want"),
    [
        (None, 200, [], ("SUCCESS", None)),
        (None, 204, [], ("SUCCESS", None)),
        (None, 201, [200], ("NON_RETRYABLE", "HTTP_201_FORA_DE_SUCCESS_STATUSES")),
        (None, 409, [200, 409], ("SUCCESS", None)),
        (None, 301, [], ("NON_RETRYABLE", "HTTP_301_REDIRECT")),
        (None, 400, [], ("NON_RETRYABLE", "HTTP_400")),
        (None, 408, [], ("RETRYABLE", "HTTP_408")),
        (None, 429, [], ("RETRYABLE", "HTTP_429")),
        (None, 503, [], ("RETRYABLE", "HTTP_503")),
        (None, 100, [], ("RETRYABLE", "HTTP_100")),
        ("ECONNREFUSED", None, [], ("RETRYABLE", "ECONNREFUSED")),
    ],
)
def test_classify(spark, net, status, listed, want):
    df = spark.createDataFrame([(net, status, listed)], "net string, status int, listed array<int>")
    v = df.select(retry.classify(F.col("net"), F.col("status"), F.col("listed")).alias("v")).first().v
    assert (v.kind, v.why) == want


def test_retry_after(spark):
    now = datetime(2015, 10, 21, 7, 27)
    cases = [
        ("120", 120_000.0),
        ("-5", 0.0),
        ("0.5", 500.0),
        ("Wed, 21 Oct 2015 07:28:00 GMT", 60_000.0),
        ("Wed, 21 Oct 2015 07:00:00 GMT", 0.0),
        ("2015-10-21T07:28:00Z", 60_000.0),
        ("soon", None),
        ("", 0.0),
        (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    got = values(df.withColumn("w", retry.retry_after_ms(F.col("h"), F.lit(now).cast("timestamp"))), "w")
    assert got == [want for _, want in cases]


def backoff(spark, attempt, asked=None, exponential=True, jitter=0.0, draw=0.5, top=3_600_000):
    column = retry.backoff_ms(
        F.lit(attempt), F.lit(15_000), F.lit(top), F.lit(2.0), F.lit(jitter), F.lit(exponential), F.lit(asked).cast("double"), F.lit(draw)
    )
    return spark.range(1).select(column).first()[0]


def test_backoff(spark):
    assert [backoff(spark, a) for a in (1, 2, 3, 5)] == [15_000, 30_000, 60_000, 240_000]
    assert backoff(spark, 50) == 3_600_000
    assert backoff(spark, 5, exponential=False) == 15_000
    assert backoff(spark, 1, jitter=0.2, draw=0.0) == 12_000
    assert backoff(spark, 1, jitter=0.2, draw=1.0) == 18_000
    assert backoff(spark, 1, asked=5_000.0) == 5_000
    assert backoff(spark, 1, asked=9e9) == 3_600_000
    draws = spark.range(1000).select(retry.unit_draw(F.col("id").cast("string")).alias("u"))
    low, high, mean = draws.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.05 and 0.95 < high < 1 and abs(mean - 0.5) < 0.05


# --- dates -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("template", "now", "want"),
    [
        ("{today}", "2024-03-15T12:00:00Z", "2024-03-15"),
        ("{today-2d}", "2024-03-01T12:00:00Z", "2024-02-28"),
        ("{today+2d}", "2023-12-30T12:00:00Z", "2024-01-01"),
        ("{today + 1d}", "2024-03-15T12:00:00Z", "2024-03-16"),
        # 22:00 in Sao Paulo is the next day in UTC
        ("{today}", "2024-03-16T01:00:00Z", "2024-03-15"),
        ("from {today-1d} to {today}", "2024-03-15T12:00:00Z", "from 2024-03-14 to 2024-03-15"),
        ("fixed", "2024-03-15T12:00:00Z", "fixed"),
        ("{todayx}", "2024-03-15T12:00:00Z", "{todayx}"),
    ],
)
def test_date_templates(spark, template, now, want):
    column = resolve_date_template(template, F.to_timestamp(F.lit(now)), "America/Sao_Paulo")
    assert spark.range(1).select(column).first()[0] == want


def test_month_partition(spark):
    at = F.to_timestamp(F.lit("2024-01-31T23:59:59Z"))
    assert spark.range(1).select(month_partition(at)).first()[0] == "202401"


# --- redaction -------------------------------------------------------------

TOKEN = r"\*\*\*\[[0-9a-f]{8}\]"


def masked_headers(spark, headers, secrets=()):
    df = spark.createDataFrame([(headers,)], "h map<string,string>")
    return df.select(redact.mask_headers(F.col("h"), secrets)).first()[0]


def test_mask_headers(spark):
    import re

    got = masked_headers(
        spark,
        {
            "Authorization": "Bearer eyJ.abc",
            "Proxy-Authorization": "Basic dXNlcjpwdw==",
            "X-Api-Key": "valor-sensivel-1",
            "Set-Cookie": "sid=1",
            "My-Client-Secret": "s",
            "Content-Type": "application/json",
            "X-Request-Id": "req-42 tok-super-secreto-1",
        },
        ["tok-super-secreto-1"],
    )
    assert re.fullmatch("Bearer " + TOKEN, got["authorization"])
    assert re.fullmatch("Basic " + TOKEN, got["proxy-authorization"])
    for name in ("x-api-key", "set-cookie", "my-client-secret"):
        assert re.fullmatch(TOKEN, got[name])
    assert got["content-type"] == "application/json"
    assert re.fullmatch("req-42 " + TOKEN, got["x-request-id"])


def masked_url(spark, url, secrets=()):
    return spark.createDataFrame([(url,)], "u string").select(redact.mask_url(F.col("u"), secrets)).first()[0]


@pytest.mark.parametrize("name", ["token", "access_token", "api_key", "password", "sig", "signature", "key"])
def test_mask_url_parameters(spark, name):
    got = masked_url(spark, f"https://api.example/r?{name}=SECRET&pagina=2#f")
    assert "SECRET" not in got and "pagina=2" in got and got.endswith("#f") and "***%5B" in got


def test_mask_url_rest(spark):
    assert masked_url(spark, "https://user:pw@API.example/r") == "https://api.example/r"
    assert masked_url(spark, "https://api.example") == "https://api.example/"
    assert masked_url(spark, "https://api.example/r?a=1%202&keynote=x") == "https://api.example/r?a=1%202&keynote=x"
    assert masked_url(spark, "not-a-url") == "not-a-url"
    got = masked_url(spark, "https://a.example/x?innocent=tok-super-secreto-1", ["tok-super-secreto-1"])
    assert "tok-super" not in got and "***[" in got
    twice = masked_url(spark, "https://a.example/x?token=a&b=c%20d&token=b")
    assert twice.count("token=") == 1 and "b=c+d" in twice


def test_mask_body(spark):
    deep = "1"
    for _ in range(10):
        deep = f'{{"d":{deep}}}'
    bodies = [
        '{"user":"joao","c":{"password":"p4ss","client_secret":{"a":1}},"n":[1.0,2.5,null,true]}',
        deep,
        "plain tok-super-secreto-1",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    got = values(df.withColumn("m", redact.mask_body(F.col("b"), ["tok-super-secreto-1"])), "m")
    first = json.loads(got[0])
    assert first["user"] == "joao" and first["n"] == [1, 2.5, None, True] and '"n":[1,2.5' in got[0]
    assert first["c"]["password"].startswith("***[") and first["c"]["client_secret"].startswith("***[")
    assert "[profundidade excedida]" in got[1]
    assert got[2].startswith("plain ***[") and got[3] is None


def test_scrub_ignores_short_secrets_and_cuts(spark):
    df = spark.createDataFrame([("o administrador chegou",), ("x" * 3000,)], "t string")
    got = [r[0] for r in df.select(redact.scrub(F.col("t"), ["admin"])).collect()]
    assert got[0] == "o administrador chegou"
    assert got[1] == "x" * 2000 + "...[truncado]"


def test_equal_secrets_share_a_fingerprint(spark):
    row = spark.range(1).select(redact.mask_value(F.lit("v")), redact.mask_value(F.lit("v"))).first()
    assert row[0] == row[1]


def test_uuid7_is_ordered_by_time(spark):
    from sluice.functions.ids import uuid7_of

    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + timedelta(milliseconds=i)) for i in range(50)], "i int, at timestamp")
    ids = values(df.withColumn("id", uuid7_of(F.col("at"), F.col("i").cast("string"))), "id")
    assert ids == sorted(ids) and len(set(ids)) == 50
    import re

    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", i) for i in ids)


def test_bodies_beyond_the_readers_own_limits(spark):
    bodies = [
        '{"a":"' + "x" * 21_000_000 + '"}',
        '{"a":' + "1" * 1_100 + "}",
        "[" * 990 + "]" * 990,
        "[" * 1_500 + "]" * 1_500,
        '1,"␞"],[',
        '{"a":1} {}',
        "[1],",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, raw string")
    got = [r.ok for r in df.select("i", variants.parse_body(F.col("raw")).isNotNull().alias("ok")).orderBy("i").collect()]
    assert got == [True, True, True] + [False] * 6


def test_numbers_in_other_bases_of_any_length(spark):
    digits = ["f" * n for n in (1, 13, 14, 15, 16, 17, 40, 100, 250)] + ["8" + "0" * 13 + "1", "2" + "0" * 12 + "1" + "0" * 30, "00" * 30 + "a"]
    texts = [f"0x{d}" for d in digits]
    texts += [f"0b{d}" for d in ("1" * 53, "1" * 54, "1" + "0" * 52 + "1", "1" + "0" * 52 + "11", "1" * 70, "0" * 99 + "1")]
    texts += [f"0o{d}" for d in ("7" * 17, "7" * 18, "7" * 25, "1" + "0" * 40 + "1", "0")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(variants.number_of_text(F.col("t")).alias("n")).collect()]
    assert got == [float(int(t, 0)) for t in texts]
    over = spark.createDataFrame([("0x" + "f" * 257,)], "t string")
    assert over.select(variants.number_of_text(F.col("t")).alias("n")).first().n is None


def test_canonical_numbers_and_escapes(spark):
    raw = ['{"b":1e3,"a":[5e-7,1.5e7,1e21,-2.0,0.1,12]}', '{"b":1000,"a":[5E-7,15000000.0,1e21,-2,0.1,12]}', '{"s":"1.0E7 \\" 2.0","t":"\\u001f\\u000B\\\\u001F"}']
    df = spark.createDataFrame([(r,) for r in raw], "raw string").withColumn("doc", F.parse_json("raw"))
    texts = [r.t for r in df.select(variants.canonical_json(F.col("doc")).alias("t")).collect()]
    assert texts[0] == texts[1] == '{"a":[5e-7,15000000,1e+21,-2,0.1,12],"b":1000}'
    assert texts[2] == '{"s":"1.0E7 \\" 2.0","t":"\\u001f\\u000b\\\\u001F"}'


def test_scrub_of_thousands_of_secrets(spark):
    import random
    import re

    from sluice.functions.redact import any_of, scrub

    rng = random.Random(8)
    secrets = [f"{rng.choice(['sk-', 'tok_', 'a.b*', ''])}{rng.randrange(10**9):09d}{'x' * rng.randrange(4)}" for _ in range(5_000)]
    secrets += ["prefix-abc", "prefix-abcdef", "short"]
    pattern = re.compile(any_of(s for s in secrets if len(s) >= 8))
    assert pattern.sub("#", "prefix-abcdefg prefix-abcx short") == "#g #x short"
    texts = [f"call {rng.choice(secrets)} and {rng.choice(secrets)}!" for _ in range(40)] + ["nothing here", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    scrubbed = frame.select("t", scrub(F.col("t"), secrets).alias("s"))
    for text, masked in scrubbed.collect():
        if text is None:
            assert masked is None
            continue
        assert not any(s in masked for s in secrets if len(s) >= 8)
        assert masked == pattern.sub(lambda m: "***[" + hashlib.sha256(m[0].encode()).hexdigest()[:8] + "]", text)
    plan = scrubbed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 0 and "Python" not in plan
