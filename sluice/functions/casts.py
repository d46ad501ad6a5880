"""Casts of JSON values to JSON text fragments.

Every cast maps a present VARIANT to `(fragment, problem)`: JSON text of the
result, or the reason it could not be made. Exactly one of the two is NULL.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.variants import (
    Value,
    double_text,
    finite,
    is_blank,
    js_trim,
    number_of_text,
    rarely,
    scalar_text,
)

# Fixed value: the greatest distance from the epoch, in milliseconds, a date may have.
_MAX_EPOCH_MS = 8.64e15
_ISO_DATE = (
    r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
    r"(Z|[+-][0-9]{2}:[0-9]{2})?)?)?)?$"
)
_ISO_OUT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def json_string(text: Column) -> Column:
    """JSON string literal of a text column."""
    return F.to_json(text.cast("variant"))


def json_literal(value: Any) -> str:
    """JSON text of a spec scalar; whole floats print without a fraction."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def parse_instant(text: Column) -> Column:
    """TIMESTAMP of ISO-8601 text (a blank instead of T is allowed; no zone means UTC)."""
    return F.when(text.rlike(_ISO_DATE), F.try_to_timestamp(text))


def _number(value: Value) -> Column:
    text = value.text
    read = F.coalesce(number_of_text(text), F.when(is_blank(text), F.lit(0.0)))
    return (
        F.when(value.kind == "BOOLEAN", (text == "true").cast("double"))
        .when(value.kind == "STRING", read)
        .otherwise(finite(text.try_cast("double")))
    )


def _millis(value: Value) -> Column:
    number = value.text.try_cast("double")
    in_range = F.abs(number) <= F.lit(_MAX_EPOCH_MS)
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    parsed = F.unix_millis(parse_instant(value.text))
    return F.when(value.is_number, F.when(in_range, whole.cast("bigint"))).otherwise(parsed)


_BY_NUMBER = ("number", "integer")
_BY_DATE = ("iso-date", "epoch-millis")


def cast_input(value: Value, cast: str) -> dict[str, Column]:
    """What a cast needs of the value, each to be put in a column: `text`, `number`, `millis`."""
    needed = {"text": scalar_text(value)}
    if cast in _BY_NUMBER:
        needed["number"] = _number(value)
    elif cast in _BY_DATE:
        needed["millis"] = _millis(value)
    return needed


def cast_result(value: Value, cast: str, given: dict[str, Column]) -> tuple[Column, Column]:
    """(fragment, problem) from the columns of `cast_input`."""
    text = given["text"]
    shown = F.concat(F.lit("valor '"), F.coalesce(text, F.lit(M.OBJECT_TEXT)), F.lit("' "))

    def problem_if(bad: Column, what: str) -> Column:
        return F.when(bad, F.concat(shown, F.lit(what)))

    if cast in ("string", "trim", "upper", "lower"):
        shape = {"string": lambda t: t, "trim": js_trim, "upper": F.upper, "lower": F.lower}[cast]
        return json_string(shape(text)), F.when(text.isNull(), M.NOT_SCALAR.format(cast=cast))
    if cast in _BY_NUMBER:
        number = given["number"]
        fragment = F.when(value.is_number, text).otherwise(rarely(number.isNotNull(), number, double_text))
        problem = problem_if(number.isNull(), M.NOT_NUMBER)
        if cast == "integer":
            broken = F.floor(number) != number
            problem = F.coalesce(problem, problem_if(broken, M.NOT_INTEGER))
            fragment = F.when(~broken, fragment)
        return fragment, problem
    if cast == "boolean":
        word = F.lower(text)
        flag = F.when(word.isin(*M.TRUE_WORDS), "true").when(word.isin(*M.FALSE_WORDS), "false")
        known = word.isin(*M.TRUE_WORDS, *M.FALSE_WORDS)
        return flag, problem_if(~F.coalesce(known, F.lit(False)), M.NOT_BOOLEAN)
    if cast in _BY_DATE:
        millis = given["millis"]
        problem = problem_if(millis.isNull(), M.NOT_DATE)
        if cast == "epoch-millis":
            return millis.cast("string"), problem
        return json_string(F.date_format(F.timestamp_millis(millis), _ISO_OUT)), problem
    raise ValueError(f"unknown cast '{cast}'")
