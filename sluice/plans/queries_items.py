"""Queries over single items: paths, predicates, canonical form, keys, casts, transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.casts import cast_input, cast_result
from sluice.functions.predicates import matches_any
from sluice.functions.reshape import apply_transform
from sluice.functions.variants import (
    bind,
    canonical_json,
    extract_paths,
    is_object,
    item_hash,
    number_of_text,
    path_get,
    strip_nul,
    type_class,
)
from sluice.operators.filtering import filter_items
from sluice.operators.keys import dedupe_key, with_dedupe_key
from sluice.plans import frames
from sluice.plans.registry import query
from sluice.sources.pages import page_documents
from sluice.spec import DedupeSpec, compile_transform

NOTE = """CASE event_id % 5 WHEN 2 THEN '' WHEN 3 THEN '  n' || user_id || ' ' WHEN 4 THEN 'Nota' END"""
VALUE = r"regexp_replace(CAST(value AS VARCHAR), '\.0$', '')"
K = r"regexp_extract(props, '([0-9]+)', 1)"
AT = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
CANONICAL = f"""
'{{"at":"' || {AT} || '","code":' ||
CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '"' || user_id || '"' END ||
',"event_id":' || event_id || ',"flag":' ||
CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"sim"' ELSE '"x"' END ||
CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ',"note":null' ELSE ',"note":"' || {NOTE} || '"' END ||
',"props":{{"k":' || {K} || '}},"type":"' || event_type || '","value":' || {VALUE} || '}}'
"""


# --- paths -----------------------------------------------------------------

_PATHS = {
    "first": "a[0]",
    "inner": "a.1.b",
    "member": "0",
    "behind_null": "n.x",
    "name_on_array": "a.b",
    "reserved": "a[1].__proto__",
    "past_end": "a[5]",
    "on_scalar": "s.x",
}


@query(
    "pth_path_get",
    """
    SELECT event_id, CAST(event_id AS VARCHAR) AS first, CAST(user_id AS VARCHAR) AS "inner",
           '"z' || user_id || '"' AS member, CAST(NULL AS VARCHAR) AS behind_null,
           CAST(NULL AS VARCHAR) AS name_on_array, CAST(NULL AS VARCHAR) AS reserved,
           CAST(NULL AS VARCHAR) AS past_end, CAST(NULL AS VARCHAR) AS on_scalar,
           'null' AS type_of_null
    FROM events
    """,
)
def pth_path_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frames.table(spark, sf_dir, "events")
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = F.concat(
        F.lit('{"a":['), n, F.lit(',{"b":'), u, F.lit('}],"0":"z'), u, F.lit('","n":null,"s":1}')
    )
    docs = events.select("event_id", F.parse_json(raw).alias("doc"))
    return docs.select(
        "event_id",
        *[F.to_json(path_get(F.col("doc"), path)).alias(name) for name, path in _PATHS.items()],
        type_class(path_get(F.col("doc"), "n")).alias("type_of_null"),
    )


# --- predicates ------------------------------------------------------------


def _kept(spark: SparkSession, sf_dir: str, declared: dict) -> DataFrame:
    kept = filter_items(frames.items(spark, sf_dir), declared)
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


def _kept_sql(condition: str) -> str:
    return f"""
    SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
    FROM events WHERE {condition} GROUP BY event_type
    """


_FILTERS = {
    "flt1_in": ({"type": ["click", "purchase"]}, "event_type IN ('click', 'purchase')"),
    "flt2_not_in": ({"note": {"notIn": ["Nota", "x"]}}, "event_id % 5 IN (2, 3)"),
    "flt3_equals": ({"code": {"equals": 7}}, "user_id = 7"),
    "flt4_not_equals": ({"note": {"notEquals": ""}}, "event_id % 5 IN (3, 4)"),
    "flt6_exists": ({"note": {"exists": True}}, "event_id % 5 IN (2, 3, 4)"),
    "flt6_not_exists": ({"note": {"exists": False}}, "event_id % 5 IN (0, 1)"),
    "flt8_filter": (
        {"code": {"numeric": True, "notEquals": 0}, "props.k": {"notIn": [1, "2", 3]}, "flag": [True]},
        "user_id <> 0 AND event_id % 3 = 0 AND props NOT IN "
        "('{\"k\": 1}', '{\"k\": 2}', '{\"k\": 3}')",
    ),
    "flt9_null_literal": ({"note": [None, "Nota"]}, "event_id % 5 = 4"),
    "flt10_empty_rule": ({"note": {"numeric": False}}, "true"),
}


def _register_filters() -> None:
    for name, (declared, condition) in _FILTERS.items():

        def run(spark: SparkSession, sf_dir: str, declared: dict = declared) -> DataFrame:
            return _kept(spark, sf_dir, declared)

        query(name, _kept_sql(condition))(run)


_register_filters()

# Seven spellings of a number, by event; %7 = 6 is the event's own value.
_MIXED = ('""', '"  "', '" 12 "', '"0x1F"', '"1e3"', "true")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 7
    text = F.coalesce(
        F.get(F.array(*[F.lit(m) for m in _MIXED]), n.cast("int")), F.col("value").cast("string")
    )
    events = frames.table(spark, sf_dir, "events")
    return events.select(
        "event_id", n.alias("kind"), F.parse_json(F.concat(F.lit('{"m":'), text, F.lit("}"))).alias("item")
    )


@query(
    "flt5_numeric",
    """
    SELECT event_id % 7 AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
    FROM events WHERE event_id % 7 NOT IN (0, 1, 5) GROUP BY 1
    """,
)
def flt5_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filter_items(_mixed(spark, sf_dir), {"m": {"numeric": True}})
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "flt7_same_value",
    """
    SELECT event_id,
           event_id % 7 = 2 OR event_id % 7 = 6 AND value = 12 AS number_12,
           event_id % 7 = 6 AND value = 12 AS text_12,
           event_id % 7 IN (3, 4) OR event_id % 7 = 6 AND value IN (31, 1000) AS hex_or_exponent,
           event_id % 7 = 5 AS true_only
    FROM events
    """,
)
def flt7_same_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, value_of = extract_paths(_mixed(spark, sf_dir), "item", ["m"])

    def same(value: object) -> Column:
        return matches_any(value_of("m"), value if isinstance(value, list) else [value])

    return values.select(
        "event_id",
        same(12).alias("number_12"),
        same("12").alias("text_12"),
        same([31, 1000]).alias("hex_or_exponent"),
        same([True, "true"]).alias("true_only"),
    )


# --- canonical form --------------------------------------------------------


@query(
    "can1_canonical_json",
    f"SELECT event_id, canonical, sha256(canonical) AS item_hash FROM (SELECT event_id, {CANONICAL} AS canonical FROM events)",
)
def can1_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).select(
        "event_id",
        canonical_json(F.col("item")).alias("canonical"),
        item_hash(F.col("item")).alias("item_hash"),
    )


@query(
    "can2_item_hash_lineitem",
    r"""
    SELECT l_returnflag, count(*) AS n, count(DISTINCT h) AS n_hashes, min(h) AS low, max(h) AS high
    FROM (SELECT l_returnflag,
                 sha256('{"flag":"' || l_returnflag || '","line":' || l_linenumber || ',"order":' || l_orderkey ||
                        ',"price":' || regexp_replace(CAST(l_extendedprice AS VARCHAR), '\.0$', '') ||
                        ',"quantity":' || regexp_replace(CAST(l_quantity AS VARCHAR), '\.0$', '') ||
                        ',"ship":{"day":"' || strftime(l_shipdate, '%Y-%m-%d') || '","part":' || l_partkey || '}}') AS h
          FROM lineitem)
    GROUP BY l_returnflag
    """,
)
def can2_item_hash_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(
        F.lit('{"order":'),
        F.col("l_orderkey").cast("string"),
        F.lit(',"line":'),
        F.col("l_linenumber").cast("string"),
        F.lit(',"ship":{"part":'),
        F.col("l_partkey").cast("string"),
        F.lit(',"day":"'),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.lit('"},"quantity":'),
        F.col("l_quantity").cast("string"),
        F.lit(',"price":'),
        F.col("l_extendedprice").cast("string"),
        F.lit(',"flag":"'),
        F.col("l_returnflag"),
        F.lit('"}'),
    )
    lines = frames.table(spark, sf_dir, "lineitem")
    hashed = lines.select("l_returnflag", item_hash(F.parse_json(raw)).alias("h"))
    return hashed.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("h").alias("n_hashes"),
        F.min("h").alias("low"),
        F.max("h").alias("high"),
    )


@query(
    "san1_strip_nul",
    "SELECT doc_id, sha256(text || source) AS h, source AS inner_key FROM documents",
)
def san1_strip_nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    nul = F.lit("\\u0000")
    body = F.to_json(F.concat(F.col("text"), F.lit("\0"), F.col("source")).cast("variant"))
    raw = F.concat(F.lit('{"t":'), body, F.lit(',"'), nul, F.lit("k"), nul, nul, F.lit('":'), F.to_json(F.col("source").cast("variant")), F.lit("}"))
    parsed = docs.select("doc_id", F.parse_json(strip_nul(raw)).alias("doc"))
    return parsed.select(
        "doc_id",
        F.sha2(F.try_variant_get("doc", "$.t", "string"), 256).alias("h"),
        F.try_variant_get("doc", "$.k", "string").alias("inner_key"),
    )


# --- keys ------------------------------------------------------------------

_CODE_TYPE = "'field:code=' || user_id || '|field:type=' || event_type"


def _with_headers(items: DataFrame) -> DataFrame:
    n = F.col("event_id")
    header = F.when(n % 4 == 0, F.create_map(F.lit("x-key"), F.concat(F.lit("h"), n.cast("string"))))
    header = header.when(n % 4 == 1, F.create_map(F.lit("x-key"), F.lit("")))
    origin = F.when(n % 8 == 0, "poll").otherwise("endpoint")
    return items.withColumns({"headers": header, "origin_kind": origin})


@query(
    "key1_composite",
    f"SELECT event_id, {_CODE_TYPE} AS dedupe_source, sha256({_CODE_TYPE}) AS dedupe_key FROM events",
)
def key1_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_dedupe_key(frames.items(spark, sf_dir), DedupeSpec(fields=("code", "type")))
    return keyed.select("event_id", "dedupe_source", "dedupe_key")


@query(
    "key2_part_value",
    f"""
    SELECT event_id,
           CASE WHEN event_id % 5 IN (3, 4) THEN 'field:note=' || {NOTE} END AS by_note,
           CASE event_id % 3 WHEN 0 THEN 'field:flag=true' WHEN 1 THEN 'field:flag=sim' ELSE 'field:flag=x' END AS by_flag,
           'field:value=' || {VALUE} AS by_value,
           CAST(NULL AS VARCHAR) AS by_object
    FROM events
    """,
)
def key2_part_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = frames.items(spark, sf_dir)
    for path in ("note", "flag", "value"):
        items = with_dedupe_key(items, DedupeSpec(fields=(path,))).withColumnRenamed(
            "dedupe_source", f"by_{path}"
        )
    keyed = with_dedupe_key(items, DedupeSpec(fields=("props",)))
    return keyed.select(
        "event_id", "by_note", "by_flag", "by_value", F.col("dedupe_source").alias("by_object")
    )


@query(
    "key3_key4_header_then_fields",
    f"""
    SELECT event_id,
           CASE WHEN event_id % 8 = 4 THEN 'header:x-key=h' || event_id ELSE {_CODE_TYPE} END AS dedupe_source
    FROM events
    """,
)
def key3_key4_header_then_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DedupeSpec(header="X-Key", fields=("code", "type"), on_missing="reject")
    keyed = with_dedupe_key(_with_headers(frames.items(spark, sf_dir)), spec)
    return keyed.select("event_id", "dedupe_source")


@query(
    "key5_generate",
    f"""
    SELECT event_id, src AS dedupe_source, sha256(src) AS dedupe_key
    FROM (SELECT event_id, CASE WHEN event_id % 5 IN (3, 4) THEN 'field:note=' || {NOTE}
                                ELSE 'sha256(item)=' || sha256({CANONICAL}) END AS src FROM events)
    """,
)
def key5_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DedupeSpec(fields=("note",), on_missing="generate")
    keyed = with_dedupe_key(frames.items(spark, sf_dir), spec)
    return keyed.select("event_id", "dedupe_source", "dedupe_key")


@query(
    "key6_reject",
    f"""
    SELECT event_id, '{M.DEDUPE_KEY_MISSING}' AS reason,
           'nenhuma chave de deduplicacao resolvida (esperado header:x-key ou field:note+field:code)' AS detail
    FROM events WHERE event_id % 5 IN (0, 1, 2) AND NOT (event_id % 8 = 4)
    """,
)
def key6_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DedupeSpec(header="X-Key", fields=("note", "code"), on_missing="reject")
    _, rejected = dedupe_key(_with_headers(frames.items(spark, sf_dir)), spec)
    return rejected.select("event_id", "reason", "detail")


# --- casts -----------------------------------------------------------------


def _cast(spark: SparkSession, sf_dir: str, path: str, cast: str, mixed: bool = False) -> DataFrame:
    items = _mixed(spark, sf_dir) if mixed else frames.items(spark, sf_dir)
    read, value_of = extract_paths(items.select("event_id", "item"), "item", [path])
    value = value_of(path)
    given = cast_input(value, cast)
    staged = bind(read.filter(~value.absent), given)
    fragment, problem = cast_result(value, cast, {name: F.col(name) for name in given})
    return staged.select("event_id", fragment.alias("fragment"), problem.alias("problem"))


def _case(whens: str) -> str:
    return f"CASE event_id % 7 {whens} END"


_NO_PROBLEM = "CAST(NULL AS VARCHAR) AS problem"
_CASTS = {
    "cst1_string": (
        ("m", "string", True),
        "SELECT event_id, '\"' || "
        + _case(
            "WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN ' 12 ' WHEN 3 THEN '0x1F' WHEN 4 THEN '1e3' "
            f"WHEN 5 THEN 'true' ELSE {VALUE}"
        )
        + f" || '\"' AS fragment, {_NO_PROBLEM} FROM events",
    ),
    "cst2_number": (
        ("m", "number", True),
        "SELECT event_id, "
        + _case(
            "WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN '12' WHEN 3 THEN '31' WHEN 4 THEN '1000' "
            f"WHEN 5 THEN '1' ELSE {VALUE}"
        )
        + f" AS fragment, {_NO_PROBLEM} FROM events",
    ),
    "cst3_integer": (
        ("m", "integer", True),
        "SELECT event_id, "
        + _case(
            "WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN '12' WHEN 3 THEN '31' WHEN 4 THEN '1000' "
            f"WHEN 5 THEN '1' ELSE CASE WHEN value = floor(value) THEN {VALUE} END"
        )
        + f" AS fragment, CASE WHEN event_id % 7 = 6 AND value <> floor(value) THEN 'valor ''' || {VALUE} || ''' nao e inteiro' END AS problem FROM events",
    ),
    "cst4_boolean": (
        ("flag", "boolean", False),
        """
        SELECT event_id, CASE WHEN event_id % 3 IN (0, 1) THEN 'true' END AS fragment,
               CASE WHEN event_id % 3 = 2 THEN 'valor ''x'' nao e booleano' END AS problem
        FROM events
        """,
    ),
    "cst5_iso_date": (
        ("at", "iso-date", False),
        f"SELECT event_id, '\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '\"' AS fragment, {_NO_PROBLEM} FROM events",
    ),
    "cst6_epoch_millis": (
        ("at", "epoch-millis", False),
        f"SELECT event_id, CAST(CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS VARCHAR) AS fragment, {_NO_PROBLEM} FROM events",
    ),
    "cst7_trim": (
        ("note", "trim", False),
        f"SELECT event_id, '\"' || trim({NOTE}) || '\"' AS fragment, {_NO_PROBLEM} FROM events WHERE event_id % 5 > 1",
    ),
    "cst8_upper": (
        ("type", "upper", False),
        f"SELECT event_id, '\"' || upper(event_type) || '\"' AS fragment, {_NO_PROBLEM} FROM events",
    ),
    "cst9_lower": (
        ("note", "lower", False),
        f"SELECT event_id, '\"' || lower({NOTE}) || '\"' AS fragment, {_NO_PROBLEM} FROM events WHERE event_id % 5 > 1",
    ),
}


def _register_casts() -> None:
    for name, (args, sql) in _CASTS.items():

        def run(spark: SparkSession, sf_dir: str, args: tuple = args) -> DataFrame:
            return _cast(spark, sf_dir, *args)

        query(name, sql)(run)


_register_casts()


# --- transform -------------------------------------------------------------


def _transformed(spark: SparkSession, sf_dir: str, rules: dict) -> DataFrame:
    items = frames.items(spark, sf_dir).select("event_id", "item")
    return apply_transform(items, compile_transform(rules), "item", problem="err_detail").drop("item")


@query(
    "trf1_reshape",
    f"""
    SELECT event_id,
           '{{"codigo":' || user_id || ',"evento":{{"id":' || event_id || ',"tipo":"' || upper(event_type) ||
           '"}},"k":' || {K} || CASE WHEN event_id % 5 > 1 THEN ',"nota":"' || trim({NOTE}) || '"' ELSE '' END ||
           ',"origem":"poll"}}' AS body,
           CAST(NULL AS VARCHAR) AS err_detail
    FROM events
    """,
)
def trf1_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(spark, sf_dir, frames.poll_flow().transform)


@query(
    "trf2_trf5_objects_defaults_omission",
    f"""
    SELECT event_id,
           '{{"0":"first","a":{{"b":' || CASE WHEN event_id % 5 > 1 THEN '"' || {NOTE} || '"' ELSE 'null' END ||
           '}},"c":null,"d":{{"k":' || {K} || '}}' ||
           CASE WHEN event_id % 5 > 1 THEN ',"e":{{"f":{{"g":"' || {NOTE} || '"}}}}' ELSE '' END ||
           ',"h":' || CASE WHEN event_id % 5 > 1 THEN '"' || lower({NOTE}) || '"' ELSE '"  Kept AS Is "' END ||
           ',"i":1.5}}' AS body,
           CAST(NULL AS VARCHAR) AS err_detail
    FROM events
    """,
)
def trf2_trf5_objects_defaults_omission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "a.b": {"from": "note", "default": None},
        "c": {"const": None},
        "d": {"from": "props"},
        "e.f.g": {"from": "note"},
        "e.x": {"from": "missing.path"},
        "h": {"from": "note", "cast": "lower", "default": "  Kept AS Is "},
        "i": {"const": 1.5},
        "0": {"const": "first"},
    }
    return _transformed(spark, sf_dir, rules)


@query(
    "trf6_first_failing_cast",
    f"""
    SELECT event_id,
           CASE WHEN event_id % 3 <> 2 AND event_id % 5 NOT IN (3, 4) THEN
             '{{"a":' || event_id || ',"b":true' ||
             CASE WHEN event_id % 5 = 2 THEN ',"c":0' ELSE '' END || '}}' END AS body,
           CASE WHEN event_id % 3 = 2 THEN 'campo ''flag'': valor ''x'' nao e booleano'
                WHEN event_id % 5 IN (3, 4) THEN 'campo ''note'': valor ''' || {NOTE} || ''' nao e numero' END AS err_detail
    FROM events
    """,
)
def trf6_first_failing_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "c": {"from": "note", "cast": "number"},
        "b": {"from": "flag", "cast": "boolean"},
        "a": {"from": "event_id"},
    }
    return _transformed(spark, sf_dir, rules)


@query(
    "cst2_long_based_texts",
    "SELECT event_id, power(16.0, event_id % 90 + 1) - 1 AS as_number, event_id % 90 > 0 AS kept FROM events",
)
def cst2_long_based_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal texts of 1 to 90 digits as numbers, and through a filter: none of them ends the job."""
    n = F.col("event_id") % 90
    text = F.concat(F.lit("0x"), F.repeat(F.lit("f"), (n + 1).cast("int")))
    raw = F.concat(F.lit('{"m":"'), text, F.lit('"}'))
    items = frames.table(spark, sf_dir, "events").select("event_id", text.alias("t"), F.parse_json(raw).alias("item"))
    kept = filter_items(items, {"m": {"numeric": True, "notEquals": 15}}).select(F.col("event_id").alias("k"))
    return items.join(kept, F.col("event_id") == F.col("k"), "left").select(
        "event_id", number_of_text(F.col("t")).alias("as_number"), F.col("k").isNotNull().alias("kept")
    )


@query(
    "src1_bodies_past_reader_limits",
    """
    SELECT CAST(event_id // 50 AS VARCHAR) AS ingest_id, CAST(event_id // 10 % 5 + 1 AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS error_code,
           CASE WHEN event_id // 10 % 5 = 2 THEN 1 ELSE 2 END AS n_items
    FROM events GROUP BY ALL
    """,
)
def src1_bodies_past_reader_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a number of 1,100 digits, 900 nested levels and, once in 10,000 events, a string of more than
    20,000,000 characters: they are read, and the pages behind them are not lost."""
    n = F.col("event_id")
    cycle, page = F.floor(n / 50), (F.floor(n / 10) % 5 + 1).cast("int")
    landed = frames.table(spark, sf_dir, "events").groupBy(cycle.alias("cycle_id"), page.alias("page")).agg(F.count("*").alias("n"))
    text = F.repeat(F.lit("x"), F.when(F.col("cycle_id") % 200 == 0, F.lit(20_000_001)).otherwise(F.lit(1)))
    deep = F.concat(F.repeat(F.lit("["), 900), F.repeat(F.lit("]"), 900))
    odd = (
        F.when(F.col("page") == 1, F.concat(F.lit('{"s":"'), text, F.lit('"}')))
        .when(F.col("page") == 2, F.concat(F.lit('{"n":'), F.repeat(F.lit("1"), 1_100), F.lit("}")))
        .when(F.col("page") == 3, deep)
        .when(F.col("page") == 4, F.concat(F.lit('{"a":'), deep, F.lit("}")))
        .otherwise(F.lit("{}"))
    )
    body = F.concat(F.lit('{"itens":['), odd, F.lit(',{"k":1}],"totalRegistros":999999}'))
    at = F.timestamp_seconds(F.unix_seconds(F.lit(frames.NOW).cast("timestamp")) + F.col("cycle_id") * 60 + F.col("page"))
    pages = landed.select("cycle_id", "page", at.alias("fetched_at"), body.alias("body"), F.lit(200).alias("http_status"))
    documents = page_documents(pages, frames.poll_flow())
    found = F.filter(F.try_variant_get("doc", "$.itens", "array<variant>"), is_object)
    return documents.select("ingest_id", "page", "error_code", F.size(found).alias("n_items"))
