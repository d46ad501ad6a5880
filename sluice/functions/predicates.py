"""Filter predicates compiled to boolean columns (never NULL)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.variants import JS_SPACE, Value, ValueOf, finite, number_of_text
from sluice.spec import FilterRule


def matches_any(value: Value, wanted: Iterable[Any]) -> Column:
    """True when `value` is the same as one of the literals.

    Same means equal within one type, except that a number and a numeric string
    are compared as numbers. Booleans never mix; a null literal never matches.
    """
    wanted = list(wanted)
    flags = sorted({w for w in wanted if isinstance(w, bool)})
    numbers = sorted({float(w) for w in wanted if isinstance(w, (int, float)) and not isinstance(w, bool)})
    texts = sorted({w for w in wanted if isinstance(w, str)})

    # a numeric string among the literals also stands for its number
    as_numbers = [n for n in map(_literal_number, texts) if n is not None]
    is_string = value.kind == "STRING"
    tests = []
    if texts:
        tests.append(is_string & value.text.isin(texts))
    if numbers or as_numbers:
        tests.append(value.is_number & value.text.try_cast("double").isin(numbers + as_numbers))
    if numbers:
        tests.append(is_string & number_of_text(value.text).isin(numbers))
    if flags:
        tests.append((value.kind == "BOOLEAN") & value.text.isin([str(f).lower() for f in flags]))
    if not tests:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def _literal_number(text: str) -> float | None:
    trimmed = text.strip(JS_SPACE)
    try:
        if trimmed[:2].lower() in ("0x", "0o", "0b"):
            return float(int(trimmed, 0))
        number = float(trimmed)
    except ValueError:
        return None
    plain = trimmed.replace("_", "") == trimmed and trimmed.isascii()
    return number if plain and abs(number) != float("inf") and number == number else None


def is_numeric(value: Value) -> Column:
    """A finite number, or non-blank text standing for one."""
    as_number = value.is_number & finite(value.text.try_cast("double")).isNotNull()
    as_text = (value.kind == "STRING") & number_of_text(value.text).isNotNull()
    return F.coalesce(as_number | as_text, F.lit(False))


def predicate(value: Value, kind: str, argument: Any) -> Column:
    present = F.coalesce(value.is_scalar, F.lit(False))
    if kind == "exists":
        return ~value.absent if argument else value.absent
    if kind == "in":
        return matches_any(value, argument)
    if kind == "equals":
        return matches_any(value, [argument])
    if kind == "notIn":
        return present & ~matches_any(value, argument)
    if kind == "notEquals":
        return present & ~matches_any(value, [argument])
    if kind == "numeric":
        return is_numeric(value)
    raise ValueError(f"unknown predicate '{kind}'")


def matches(rules: Iterable[FilterRule], value_of: ValueOf) -> Column:
    """AND over the rules and over the predicates of each; no rules accept everything."""
    tests = [
        predicate(value_of(rule.path), kind, argument)
        for rule in rules
        for kind, argument in rule.predicates
    ]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def filter_paths(rules: Iterable[FilterRule]) -> list[str]:
    return [rule.path for rule in rules]
