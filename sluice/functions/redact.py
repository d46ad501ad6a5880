"""Masking of credentials in audit columns.

The mask token is `***[` + the first 8 hex digits of sha256(value) + `]`, so
equal values share a fingerprint. Known secrets shorter than 8 characters are
ignored by the scrubber: they would match inside ordinary words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice import messages as M

# Header names whose whole value is a credential, and the pattern
# of parameter and member names that carry one.
SECRET_HEADERS = (
    "authorization",
    "proxy-authorization",
    "x-api-key",
    "x-apikey",
    "api-key",
    "apikey",
    "x-auth-token",
    "x-authorization",
    "x-access-token",
    "cookie",
    "set-cookie",
    "x-amz-security-token",
)
SECRET_NAME = (
    "(pass|senha|secret|token|credential|authorization|api[-_]?key|^key$|^sig$|signature|"
    "client[-_]?secret)"
)
MIN_SECRET_LENGTH = 8


def mask_value(value: Column) -> Column:
    return F.concat(F.lit("***["), F.substring(F.sha2(value, 256), 1, 8), F.lit("]"))


def _mask_text(value: str) -> str:
    return f"***[{hashlib.sha256(value.encode('utf-8', 'surrogatepass')).hexdigest()[:8]}]"


def _known(secrets: Iterable[str]) -> list[str]:
    return sorted({s for s in secrets if len(s) >= MIN_SECRET_LENGTH}, key=lambda s: (-len(s), s))


def cut(text: Column, limit: int = M.MAX_MESSAGE) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(M.TRUNCATED))
    ).otherwise(text)


def any_of(values: Iterable[str]) -> str:
    """One pattern for many texts, as a prefix tree: of those that start at a place the longest matches.

    A text is followed down the tree once per start, whatever the number of values.
    """
    root: dict = {}
    for value in values:
        node = root
        for character in value:
            node = node.setdefault(character, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = []
        for character in sorted(c for c in node if c):
            run, below = re.escape(character), node[character]
            while len(below) == 1 and "" not in below:  # a run without branches stays one piece
                ((only, deeper),) = below.items()
                run, below = run + re.escape(only), deeper
            branches.append(run + pattern(below))
        if not branches:
            return ""
        inner = f"(?:{'|'.join(branches)})" if len(branches) > 1 or "" in node else branches[0]
        return inner + "?" if "" in node else inner

    return pattern(root)


def scrub(text: Column, secrets: Iterable[str] = ()) -> Column:
    """Replace known secret values wherever they appear, then cut at 2000 characters.

    All values are looked for at once; of two that overlap the one that starts first is replaced.
    """
    known = _known(secrets)
    if not known:
        return cut(text)
    pattern = any_of(known)
    masked = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), mask_value)
    pieces = F.zip_with(F.split(text, pattern, -1), masked, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return cut(F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text))


def secret_name(name: Column) -> Column:
    return name.rlike("(?i)" + SECRET_NAME)


def lower_keys(headers: Column) -> Column:
    """Map with lower-case keys; of keys that only differ in case the last entry stays."""
    entries = F.transform(
        F.map_entries(headers),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    return F.map_from_entries(last)


def normalize_headers(headers: Column) -> Column:
    """map<string,array<string>> to map<string,string>: lower-case names, values joined by ', '."""
    joined = F.transform_values(
        F.map_filter(headers, lambda _, v: v.isNotNull()), lambda _, v: F.array_join(v, ", ")
    )
    return lower_keys(joined)


def mask_headers(headers: Column, secrets: Iterable[str] = ()) -> Column:
    """map<string,string> with credentials masked; a Bearer/Basic/Digest prefix stays readable."""
    secrets = _known(secrets)

    def masked(name: Column, value: Column) -> Column:
        scheme = F.substring_index(value, " ", 1)
        prefix = F.when(
            scheme.rlike("(?i)^(bearer|basic|digest)$"), F.concat(scheme, F.lit(" "))
        ).otherwise("")
        hidden = F.concat(prefix, mask_value(value))
        return F.when(name.isin(*SECRET_HEADERS) | secret_name(name), hidden).otherwise(
            scrub(value, secrets)
        )

    return F.transform_values(
        lower_keys(F.map_filter(headers, lambda _, v: v.isNotNull())), masked
    )


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _param(pair: Column) -> Column:
    name = _decoded(F.substring_index(pair, "=", 1))
    value = _decoded(F.when(F.instr(pair, "=") > 0, F.substr(pair, F.instr(pair, "=") + 1)).otherwise(""))
    return F.struct(name.alias("name"), value.alias("value"))


def mask_url(url: Column, secrets: Iterable[str] = ()) -> Column:
    """URL without user info and with sensitive parameters masked; other text is scrubbed only.

    The query is written anew (form encoding, one entry per masked name) only
    when it holds a sensitive parameter.
    """
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(url, shape, i), F.lit(""))

    authority = F.lower(F.regexp_replace(part(2), "^.*@", ""))
    path = F.when((part(3) == "") & part(1).rlike("(?i)^(https?|wss?|ftp)$"), "/").otherwise(part(3))
    query = part(4)
    params = F.transform(F.split(F.substring(query, 2, 2**30), "&"), _param)
    sensitive = F.exists(params, lambda p: secret_name(p["name"]))
    kept = F.filter(
        params,
        lambda p, i: (p["name"] != "") | (p["value"] != "")
    )
    once = F.filter(
        kept,
        lambda p, i: ~secret_name(p["name"])
        | ~F.exists(F.slice(kept, 1, i), lambda earlier: earlier["name"] == p["name"]),
    )
    rewritten = F.array_join(
        F.transform(
            once,
            lambda p: F.concat(
                F.url_encode(p["name"]),
                F.lit("="),
                F.url_encode(
                    F.when(secret_name(p["name"]), mask_value(p["value"])).otherwise(p["value"])
                ),
            ),
        ),
        "&",
    )
    new_query = F.when(sensitive, F.concat(F.lit("?"), rewritten)).otherwise(query)
    clean = F.concat(F.lower(part(1)), F.lit("://"), authority, path, new_query, part(5))
    return scrub(F.when(url.rlike(shape), clean).otherwise(url), secrets)


def _js_number(value: float) -> float | int:
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def _not_json(word: str) -> None:
    raise ValueError(word)


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _mask_node(node: object, known: re.Pattern | None, depth: int) -> object:
    if depth > M.MAX_MASK_DEPTH:
        return M.TOO_DEEP
    if isinstance(node, str):
        if known is not None:
            node = known.sub(lambda m: _mask_text(m[0]), node)
        return node if len(node) <= M.MAX_MESSAGE else node[: M.MAX_MESSAGE] + M.TRUNCATED
    if isinstance(node, list):
        return [_mask_node(v, known, depth + 1) for v in node]
    if isinstance(node, dict):
        return {
            k: _mask_text(v if isinstance(v, str) else _dump(v))
            if re.search(SECRET_NAME, k, re.IGNORECASE)
            else _mask_node(v, known, depth + 1)
            for k, v in node.items()
        }
    return node


def mask_body(raw: Column, secrets: Iterable[str] = ()) -> Column:
    """JSON text with sensitive members masked at any depth; text that is not JSON is scrubbed.

    Members are masked down to a fixed depth, below it all is cut off. This is the
    one Arrow-batched Python function here.
    """
    listed = _known(secrets)
    known = re.compile(any_of(listed)) if listed else None

    @F.pandas_udf("string")
    def masked(bodies: pd.Series) -> pd.Series:
        def one(body: str | None) -> str | None:
            if body is None:
                return None
            try:
                doc = json.loads(
                    body, parse_float=lambda t: _js_number(float(t)), parse_constant=_not_json
                )
            except ValueError:
                return _mask_node(body, known, 0)
            return _dump(_mask_node(doc, known, 0))

        return bodies.map(one, na_action="ignore")

    return masked(raw)
