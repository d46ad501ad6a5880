"""Keep the items a filter accepts."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from sluice.functions.predicates import filter_paths, matches
from sluice.functions.variants import drop_paths, extract_paths, fence
from sluice.spec import compile_filter


def filter_items(items: DataFrame, declared: Mapping[str, Any], item: str = "item") -> DataFrame:
    rules = compile_filter(declared)
    read, value_of = extract_paths(items, item, filter_paths(rules))
    kept = fence(read, {"_keep": matches(rules, value_of)}).filter("_keep")
    return drop_paths(kept.drop("_keep"))
