"""Transform rules rendered to a JSON body."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.casts import cast_input, cast_result, json_literal, json_string
from sluice.functions.variants import (
    bind,
    canonical_json,
    extract_paths,
    fence,
    is_object,
    parse_path,
    read_json,
    scalar_text,
)
from sluice.spec import TransformRule


@dataclass
class _Node:
    """One member of the output: leaf fragments (the last emitted wins), nested members."""

    leaves: list[Column] = field(default_factory=list)
    members: dict[str, "_Node"] = field(default_factory=dict)


def _member_order(name: str) -> tuple:
    """Position of a member: array-index-like names first by number, others as inserted."""
    if name.isdigit() and (name == "0" or name[0] != "0") and int(name) < 2**32 - 1:
        return (0, int(name))
    return (1, 0)


def _object(node: _Node) -> Column:
    """JSON object of the members that have a value; NULL when none has."""
    names = sorted(node.members, key=_member_order)
    parts = [
        F.concat(F.lit(json_literal(name) + ":"), _fragment(node.members[name])) for name in names
    ]
    inner = F.concat_ws(",", *parts)
    return F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}")))


def _fragment(node: _Node) -> Column:
    leaf = F.coalesce(*reversed(node.leaves)) if node.leaves else None
    if not node.members:
        return leaf
    nested = _object(node)
    if leaf is None:
        return nested
    # A leaf and members on the same path: the members replace a scalar or array
    # and are added to an object.
    as_doc = read_json(leaf)
    kept = F.map_filter(
        F.try_variant_get(as_doc, "$", "map<string,variant>"),
        lambda key, _: ~key.isin(*node.members),
    )
    own = F.array_join(
        F.transform(
            F.map_entries(kept),
            lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.to_json(e["value"])),
        ),
        ",",
    )
    merged = F.when(
        is_object(as_doc) & (own != ""), F.concat(F.lit("{"), own, F.lit(","), F.substring(nested, 2, 2**30))
    ).otherwise(nested)
    return F.when(nested.isNull(), leaf).otherwise(merged)


def apply_transform(
    rows: DataFrame,
    rules: Sequence[tuple[str, TransformRule]],
    doc: str = "doc",
    body: str = "body",
    problem: str = "problem",
) -> DataFrame:
    """Add the rendered `body` (JSON text) and `problem`; exactly one of the two is NULL.

    Rules run in the given order; the first failing cast is reported. A member
    whose source is absent and has no default is left out, and so is an object
    left without members. Values, cast inputs and fragments are bound in turn.
    """
    sources = [rule.source for _, rule in rules if rule.source is not None]
    staged, value_of = extract_paths(rows, doc, sources)
    inputs: dict[tuple[str, str], Column] = {}
    for _, rule in rules:
        if rule.cast is not None:
            for name, column in cast_input(value_of(rule.source), rule.cast).items():
                inputs[rule.source, name] = column
    labels = {key: f"_in_{i}" for i, key in enumerate(inputs)}
    staged = bind(staged, {labels[key]: column for key, column in inputs.items()})

    none = F.lit(None).cast("string")
    fragments: dict[str, Column] = {}
    problems: dict[str, Column] = {}
    root = _Node()
    for i, (destination, rule) in enumerate(rules):
        if rule.has_const:
            fragment = F.lit(json_literal(rule.const))
        else:
            value = value_of(rule.source)
            absent = value.absent
            if rule.cast is None:
                number = F.when(value.is_number, scalar_text(value))
                fragment = F.coalesce(number, canonical_json(value.doc))
            else:
                given = {
                    name: F.col(label) for (path, name), label in labels.items() if path == rule.source
                }
                fragment, why = cast_result(value, rule.cast, given)
                prefix = F.lit(M.FIELD_PREFIX.format(path=rule.source))
                problems[f"_problem_{i}"] = F.when(~absent, F.concat(prefix, why))
            missing = F.lit(json_literal(rule.default)) if rule.has_default else none
            fragment = F.when(absent, missing).otherwise(fragment)
        fragments[f"_fragment_{i}"] = fragment
        node = root
        for segment in parse_path(destination):
            node = node.members.setdefault(segment, _Node())
        node.leaves.append(F.col(f"_fragment_{i}"))
    staged = bind(staged, {**fragments, **problems})
    failed = F.coalesce(*[F.col(p) for p in problems]) if problems else none
    built = F.coalesce(_object(root), F.lit("{}")) if root.members else F.lit("{}")
    done = fence(staged, {body: F.when(failed.isNull(), built), problem: failed})
    return done.select(*rows.columns, body, problem)
