"""Columns over VARIANT documents: parsing, paths, type classes, text forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.spec import RESERVED_SEGMENTS

# The JSON reader's own limits are lower than what senders may send, and it takes more than JSON.
_READER = {
    "maxStringLen": str(2**31 - 1),
    "maxNumLen": "1000000",
    "allowNonNumericNumbers": "false",
    "allowSingleQuotes": "false",
}

_PATH_PREFIX = "_path_"

# The characters ECMAScript trims as white space.
_SPACE = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
JS_SPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
_DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PLAIN_TEXT = r"^-?[0-9]{1,300}(\.[0-9]{1,300})?$"
# A double as Spark prints it: with an exponent, or whole. Tokens of JSON text: strings, numbers, what is between.
_ODD_NUMBER = r"-?[0-9]+\.(?:[0-9]+E-?[0-9]+|0(?![0-9]))"
_TOKEN = r"\"(?:[^\"\\]++|\\.)*+\"|-?[0-9][0-9.E+-]*|[^\"0-9-]+|-"
_BASED_TEXT = "^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"


def parse_body(raw: Column) -> Column:
    """The document in `raw`, or NULL when the text is not exactly one JSON value.

    Spark stops reading after the first value, so `{} {}` would pass. The body
    is parsed as the first of two array members; the second is only found when
    nothing but the body stood before it. It is a hash of the body, so no body
    can hold it.
    """
    return _first_of_pair(_parse_pair(raw), raw)


def read_json(text: Column) -> Column:
    """The first JSON value of a text as VARIANT, NULL if there is none.

    Strings up to 2 GB and numbers up to a million digits are read. More than 1,000
    levels count as not JSON: the reader recurses, and deeper ones end the executor.
    """
    return F.from_json(text, "variant", _READER)


def _parse_pair(raw: Column) -> Column:
    return read_json(F.concat(F.lit("["), raw, F.lit(',"'), F.md5(raw), F.lit('"]')))


def _first_of_pair(pair: Column, raw: Column) -> Column:
    closed = F.try_variant_get(pair, "$[1]", "string") == F.md5(raw)
    alone = F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(closed & alone, F.try_variant_get(pair, "$[0]", "variant"))


def with_document(rows: DataFrame, body: str) -> DataFrame:
    """Add `parsed` (the body as sent, NUL stripped) and `doc` (an object in any case).

    Both are NULL for a body that is not JSON.
    """
    read = bind(rows, {"_raw": strip_nul(F.col(body))})
    read = bind(read, {"_pair": _parse_pair(F.col("_raw"))})
    read = fence(read, {"parsed": _first_of_pair(F.col("_pair"), F.col("_raw"))}).drop("_pair", "_raw")
    return read.withColumn("doc", wrap_body(F.col("parsed")))


def wrap_body(doc: Column) -> Column:
    """A body that is not an object becomes the object `{"value": body}`."""
    wrapped = read_json(F.concat(F.lit('{"value":'), F.to_json(doc), F.lit("}")))
    return F.when(doc.isNull() | is_object(doc), doc).otherwise(wrapped)


def is_object(doc: Column) -> Column:
    # Shallow: a struct cast looks one field up, schema_of_variant walks everything.
    return F.try_variant_get(doc, "$", "struct<_:variant>").isNotNull()


def as_array(doc: Column) -> Column:
    """array<variant>, NULL when the value is not an array."""
    return F.try_variant_get(doc, "$", "array<variant>")


def is_absent(doc: Column) -> Column:
    """True for SQL NULL (no such path) and for JSON null."""
    return doc.isNull() | F.coalesce(F.is_variant_null(doc), F.lit(True))


def parse_path(path: str) -> list[str]:
    """`a.b`, `a[0].b` and `a.0.b` give the list of segments."""
    segments: list[str] = []
    for part in path.split("."):
        segments += re.findall(r"[^\[\]]+", part)
    return segments


def _member(name: str) -> str:
    if "'" not in name:
        return f"$['{name}']"
    if '"' in name:
        raise ValueError(f"path segment with both quote kinds: {name}")
    return f'$["{name}"]'


def path_get(doc: Column, path: str) -> Column:
    """VARIANT at a dot path; NULL when absent, also behind null, scalars and reserved names.

    A run of plain names becomes one variant path. A number can be an array
    position or an object member, so both are tried.
    """
    current = doc
    names = ""
    for segment in parse_path(path):
        if re.fullmatch(r"[0-9]+", segment):
            if names:
                current, names = F.try_variant_get(current, "$" + names, "variant"), ""
            at = F.try_variant_get(current, f"$[{int(segment)}]", "variant")
            current = F.coalesce(at, F.try_variant_get(current, _member(segment), "variant"))
        elif segment in RESERVED_SEGMENTS:
            return F.try_variant_get(F.lit(None).cast("variant"), "$.x", "variant")
        else:
            names += _member(segment)[1:]
    return F.try_variant_get(current, "$" + names, "variant") if names else current


@dataclass(frozen=True)
class Value:
    """A JSON value taken apart: the VARIANT, its schema text, its text when scalar.

    Reading type and text out of a VARIANT costs more than anything done with
    them later, so both are columns of their own.
    """

    doc: Column
    kind: Column
    text: Column

    @staticmethod
    def of(doc: Column) -> Value:
        kind = F.schema_of_variant(doc)
        return Value(doc, kind, _text_of(doc, kind))

    @property
    def absent(self) -> Column:
        """No such path, or JSON null."""
        return self.kind.isNull() | (self.kind == "VOID")

    @property
    def is_number(self) -> Column:
        return _is_number_kind(self.kind)

    @property
    def is_scalar(self) -> Column:
        return _is_scalar_kind(self.kind)


def _is_number_kind(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL(")


def _is_scalar_kind(kind: Column) -> Column:
    return kind.isin("STRING", "BOOLEAN") | _is_number_kind(kind)


def _text_of(doc: Column, kind: Column) -> Column:
    return F.when(_is_scalar_kind(kind), F.try_variant_get(doc, "$", "string"))


ValueOf = Callable[[str], Value]


def bind(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later layers build on.

    Each layer is a projection of its own: Catalyst only merges two of them where
    a column is used once, so a value used often is still computed once.
    """
    return rows.withColumns(dict(columns)) if columns else rows


def fence(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later operators use as plain attributes.

    The columns come out of a one-row `inline`. Unlike with a projection, a filter
    on them is not pushed below it with every use replaced by the expression.
    """
    if not columns:
        return rows
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select("*", F.inline(F.array(packed)))


def extract_paths(
    rows: DataFrame, doc: str | Column, paths: Iterable[str]
) -> tuple[DataFrame, ValueOf]:
    """Rows with each distinct path read into columns, and the lookup by path.

    The document is walked once per path. `drop_paths` removes the columns.
    """
    source = F.col(doc) if isinstance(doc, str) else doc
    names = {path: f"{_PATH_PREFIX}{i}" for i, path in enumerate(dict.fromkeys(paths))}
    values = {
        path: Value(F.col(n), F.col(f"{n}_kind"), F.col(f"{n}_text")) for path, n in names.items()
    }
    read = bind(rows, {n: path_get(source, path) for path, n in names.items()})
    read = bind(read, {f"{n}_kind": F.schema_of_variant(n) for n in names.values()})
    texts = {f"{n}_text": _text_of(F.col(n), F.col(f"{n}_kind")) for n in names.values()}
    return bind(read, texts), values.__getitem__


def drop_paths(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith(_PATH_PREFIX)])


def type_class(doc: Column) -> Column:
    """absent | null | string | number | boolean | array | object."""
    kind = F.schema_of_variant(doc)
    return (
        F.when(doc.isNull(), "absent")
        .when(kind == "VOID", "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT<"), "object")
        .when(kind.startswith("ARRAY<"), "array")
        .otherwise("number")
    )


def is_number(doc: Column) -> Column:
    return _is_number_kind(F.schema_of_variant(doc))


def rarely(when: Column, value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` where `when` holds, else NULL, for work that few rows need.

    It is the body of a higher-order function: evaluated for these rows only, and
    no part of the generated code, which would grow beyond what Java compiles.
    """
    return F.when(when, F.get(F.transform(F.array(value), then), F.lit(0)))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def finite(number: Column) -> Column:
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def number_of_text(text: Column) -> Column:
    """DOUBLE a JSON string stands for, NULL if none; blank text is left to the caller.

    Spark's own cast takes `1d`, `NaN` and `Infinity` and refuses hexadecimal,
    hence the check of the shape first. Plain digits go the short way.
    """
    plain = text.rlike(_PLAIN_TEXT)

    def read(t: Column) -> Column:
        decimal = F.when(t.rlike(_DECIMAL_TEXT), finite(t.try_cast("double")))
        return F.coalesce(decimal, F.when(t.rlike(_BASED_TEXT), finite(_based_number(t))))

    return F.when(plain, text.try_cast("double")).otherwise(rarely(~plain, js_trim(text), read))


def _based_number(text: Column) -> Column:
    """Double of a text like 0x1f, 0o17 or 0b101 of any length, rounded once.

    The first 60 bits are read as an integer; a set bit behind them goes into its
    last one, which is too low to matter but decides ties. The rest is a power of two.
    """
    digits = F.regexp_replace(F.substring(text, 3, 2**30), "^0+", "")
    value = F.lit(0.0)
    for letter, base, bits in (("b", 2, 1), ("o", 8, 3), ("x", 16, 4)):
        size = 60 // bits
        head = F.call_function("conv", F.substring(digits, 1, size), F.lit(base), F.lit(10)).cast("bigint")
        rest = F.substring(digits, size + 1, 2**30)
        head = F.when(rest.rlike("[^0]"), head.bitwiseOR(F.lit(1).cast("bigint"))).otherwise(head)
        whole = head.cast("double") * F.pow(F.lit(2.0), F.lit(bits) * F.length(rest))
        value = F.when(F.lower(F.substring(text, 2, 1)) == letter, whole).otherwise(value)
    return F.when(digits == "", F.lit(0.0)).otherwise(value)


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{_SPACE}*$")


def _plain_decimal(text: Column, scale: int) -> Column:
    digits = text.cast(f"decimal(38,{scale})").cast("string")
    return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))


def double_text(number: Column) -> Column:
    """A double in the decimal form ECMAScript prints: no exponent from 1e-6 up to 1e21."""
    text = number.cast("string")
    size = F.abs(number)
    exponent = F.replace(
        F.regexp_replace(F.replace(text, F.lit(".0E"), F.lit("E")), "E([0-9])", "e+$1"),
        F.lit("E"),
        F.lit("e"),
    )
    return (
        F.when(size == 0, F.lit("0"))
        .when((size >= 1e21) | (size < 1e-6), exponent)
        .when(size >= 1, _plain_decimal(text, 16))
        .otherwise(_plain_decimal(text, 30))
    )


def scalar_text(value: Value) -> Column:
    """String, number or boolean as text; NULL for everything else.

    Short numbers keep the exact text VARIANT holds; exponent forms and numbers
    beyond double precision are printed from the double.
    """
    text = value.text
    tiny = text.startswith("0.000000") | text.startswith("-0.000000")
    exact = (value.kind != "DOUBLE") & (F.length(text) <= 16) & ~tiny
    short = value.kind.isin("STRING", "BOOLEAN") | exact
    return F.when(short, text).otherwise(rarely(~short, text.try_cast("double"), double_text))


def canonical_json(doc: Column) -> Column:
    """JSON text with the keys of every object sorted; array order kept.

    Numbers print the ECMAScript way, so 1e3, 1000.0 and 1000 are the same text,
    and control escapes are in lower case. Only texts that need it are rewritten.
    """
    text = F.to_json(doc)
    exact = F.when(text.rlike(_ODD_NUMBER), _plain_numbers(text)).otherwise(text)
    lower = exact
    for escape in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00{escape}", rf"$1\\u00{escape.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), lower).otherwise(exact)


def _plain_numbers(text: Column) -> Column:
    """JSON text with doubles in the form `double_text` gives; strings stay."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    odd = lambda t: t.rlike(rf"^{_ODD_NUMBER}$")
    return F.array_join(F.transform(tokens, lambda t: F.when(odd(t), double_text(t.try_cast("double"))).otherwise(t)), "")


def item_hash(doc: Column) -> Column:
    return F.sha2(canonical_json(doc), 256)


def strip_nul(raw: Column) -> Column:
    """JSON text without NUL escapes, in strings and in keys.

    An escape counts only when its backslash is not itself escaped. A raw NUL
    is not valid JSON and stays, so that parsing reports the body.
    """
    stripped = F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*)\\u0000", "$1")
    return F.when(F.contains(raw, F.lit("\\u0000")), stripped).otherwise(raw)
