"""Idempotency keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.variants import ValueOf, bind, drop_paths, extract_paths, fence, item_hash, scalar_text
from sluice.spec import DedupeSpec


def _label(kind: str, name: str) -> str:
    return f"{kind}:{name}"


def key_paths(spec: DedupeSpec) -> list[str]:
    return [name for parts in spec.alternatives for kind, name in parts if kind == "field"]


Part = tuple[str, str]


def key_parts(
    rows: DataFrame, spec: DedupeSpec, value_of: ValueOf
) -> tuple[dict[str, Column], dict[Part, Column]]:
    """Columns to bind for the text of every key part, and the lookup by part.

    A part that is missing or empty is NULL. A header part only resolves for rows
    that came through an endpoint.
    """
    texts: dict[str, Column] = {}
    parts: dict[Part, Column] = {}
    for part in dict.fromkeys(p for alternative in spec.alternatives for p in alternative):
        kind, name = part
        label = f"_part_{len(texts)}"
        if kind == "field":
            texts[label] = scalar_text(value_of(name))
        elif "headers" in rows.columns:
            text = F.col("headers")[name]
            if "origin_kind" in rows.columns:
                text = F.when(F.col("origin_kind") == "endpoint", text)
            texts[label] = text
        else:
            texts[label] = F.lit(None).cast("string")
        parts[part] = F.when(F.col(label) != "", F.col(label))
    return texts, parts


def key_source(spec: DedupeSpec, parts: dict[Part, Column], item: Column) -> Column:
    """Readable key material of the first alternative with all its parts.

    The part names belong to the material. With on_missing=generate the item's
    own hash steps in; otherwise the result is NULL.
    """
    candidates = []
    for alternative in spec.alternatives:
        pieces: list[Column] = []
        for i, (kind, name) in enumerate(alternative):
            pieces.append(F.lit(("|" if i else "") + _label(kind, name) + "="))
            pieces.append(parts[kind, name])
        # concat is NULL as soon as one part is
        candidates.append(F.concat(*pieces))
    if spec.on_missing == "generate":
        candidates.append(F.concat(F.lit("sha256(item)="), item_hash(item)))
    return F.coalesce(*candidates)


def drop_parts(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_part_")])


def missing_detail(spec: DedupeSpec) -> str:
    expected = M.KEY_ALTERNATIVE_JOIN.join(
        M.KEY_PART_JOIN.join(_label(*part) for part in alternative)
        for alternative in spec.alternatives
    )
    return M.KEY_MISSING.format(expected=expected)


def with_dedupe_key(items: DataFrame, spec: DedupeSpec, item: str = "item") -> DataFrame:
    """Add `dedupe_source` and `dedupe_key` (sha256 hex); both NULL when no key resolves."""
    read, value_of = extract_paths(items, item, key_paths(spec))
    texts, parts = key_parts(read, spec, value_of)
    keyed = fence(bind(read, texts), {"dedupe_source": key_source(spec, parts, F.col(item))})
    keyed = keyed.withColumn("dedupe_key", F.sha2("dedupe_source", 256))
    return drop_parts(drop_paths(keyed))


def dedupe_key(
    items: DataFrame, spec: DedupeSpec, item: str = "item"
) -> tuple[DataFrame, DataFrame]:
    """(keyed items, rejected items with reason and detail)."""
    keyed = with_dedupe_key(items, spec, item)
    rejected = keyed.filter(F.col("dedupe_key").isNull()).withColumns(
        {"reason": F.lit(M.DEDUPE_KEY_MISSING), "detail": F.lit(missing_detail(spec))}
    )
    return keyed.filter(F.col("dedupe_key").isNotNull()), rejected
