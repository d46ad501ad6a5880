"""Declarative flow specs: plain frozen dataclasses, checked when built.

A spec never runs anything. The compilers in `sluice.functions` and
`sluice.operators` turn it into Spark columns on the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# Names, defaults and bounds a spec must honour.
CASTS = (
    "string",
    "number",
    "integer",
    "boolean",
    "iso-date",
    "epoch-millis",
    "trim",
    "upper",
    "lower",
)
RESERVED_SEGMENTS = ("__proto__", "constructor", "prototype")
RESERVED_ROUTES = ("healthz", "readyz", "metrics", "admin")
ENDPOINT_METHODS = ("POST", "PUT", "PATCH")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
BODY_RETENTION = ("FULL", "TRUNCATED", "HASH_ONLY")
PREDICATES = ("in", "notIn", "equals", "notEquals", "numeric", "exists")
DEFAULT_TIMEZONE = "America/Sao_Paulo"
MAX_PAGES = 1_000
MAX_BODY_BYTES = 64 * 1024 * 1024
MAX_RATE_PER_MINUTE = 600_000


class SpecError(ValueError):
    """A spec breaks one of its own rules."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise SpecError(message)


def _in_range(name: str, value: float, low: float, high: float) -> None:
    _require(low <= value <= high, f"{name} must be between {low} and {high}, got {value}")


def is_scalar(value: Any) -> bool:
    return value is None or isinstance(value, (str, int, float, bool))


def check_dot_path(path: str) -> str:
    _require(bool(path), "path must not be empty")
    for part in path.split("."):
        name = re.sub(r"\[\d+\]$", "", part)
        _require(bool(part) and name not in RESERVED_SEGMENTS, f"invalid path '{path}'")
    return path


@dataclass(frozen=True)
class FilterRule:
    """All predicates on one path; they are ANDed in the order given here."""

    path: str
    predicates: tuple[tuple[str, Any], ...]


def compile_filter(declared: Mapping[str, Any] | None) -> tuple[FilterRule, ...]:
    """`{path: [values]}` or `{path: {in|notIn|equals|notEquals|numeric|exists: ...}}`."""
    rules = []
    for path, wanted in (declared or {}).items():
        check_dot_path(path)
        if isinstance(wanted, (list, tuple)):
            wanted = {"in": wanted}
        _require(isinstance(wanted, Mapping) and len(wanted) > 0, f"'{path}': no predicate given")
        unknown = [kind for kind in wanted if kind not in PREDICATES]
        _require(not unknown, f"'{path}': unknown predicates {unknown}")
        predicates = []
        for kind in PREDICATES:
            if kind not in wanted:
                continue
            value = wanted[kind]
            if kind in ("in", "notIn"):
                _require(len(value) > 0, f"'{path}': {kind} needs at least one value")
                _require(all(is_scalar(v) for v in value), f"'{path}': {kind} takes scalars")
                value = tuple(value)
            elif kind in ("equals", "notEquals"):
                _require(is_scalar(value), f"'{path}': {kind} takes a scalar")
            else:
                _require(isinstance(value, bool), f"'{path}': {kind} takes true or false")
            if kind == "numeric" and value is False:
                continue
            predicates.append((kind, value))
        rules.append(FilterRule(path, tuple(predicates)))
    return tuple(rules)


@dataclass(frozen=True)
class DedupeSpec:
    fields: Sequence[str] = ()
    header: str | None = None
    on_missing: str | None = None
    ttl_days: int = 90

    def __post_init__(self) -> None:
        for path in self.fields:
            check_dot_path(path)
        _require(self.on_missing in (None, "reject", "generate"), "on_missing: reject or generate")
        _in_range("ttl_days", self.ttl_days, 1, 3_650)

    @property
    def alternatives(self) -> tuple[tuple[tuple[str, str], ...], ...]:
        """Key candidates in order of preference, each a tuple of (kind, name) parts."""
        found = []
        if self.header is not None:
            found.append((("header", self.header.lower()),))
        if self.fields:
            found.append(tuple(("field", path) for path in self.fields))
        return tuple(found)


@dataclass(frozen=True)
class RetrySpec:
    attempts: int = 5
    backoff: str = "exponential"
    initial_delay_ms: int = 15_000
    max_delay_ms: int = 3_600_000
    factor: float = 2
    jitter: float = 0.2

    def __post_init__(self) -> None:
        _in_range("attempts", self.attempts, 1, 50)
        _require(self.backoff in ("exponential", "fixed"), "backoff: exponential or fixed")
        _in_range("initial_delay_ms", self.initial_delay_ms, 0, 3_600_000)
        _in_range("max_delay_ms", self.max_delay_ms, 0, 86_400_000)
        _in_range("factor", self.factor, 1, 10)
        _in_range("jitter", self.jitter, 0, 1)


_UNSET: Any = object()


@dataclass(frozen=True)
class TransformRule:
    """Exactly one of `source` (a path) and `const`; `cast` and `default` go with `source`."""

    source: str | None = None
    cast: str | None = None
    const: Any = _UNSET
    default: Any = _UNSET

    def __post_init__(self) -> None:
        _require(
            (self.source is not None) != self.has_const, "give exactly one of source and const"
        )
        _require(self.cast is None or self.cast in CASTS, f"unknown cast '{self.cast}'")
        _require(self.source is not None or self.cast is None, "cast only goes with source")
        _require(self.source is not None or not self.has_default, "default only goes with source")
        if self.source is not None:
            check_dot_path(self.source)
        for value in (self.const, self.default):
            _require(value is _UNSET or is_scalar(value), "const and default take scalars")

    @property
    def has_const(self) -> bool:
        return self.const is not _UNSET

    @property
    def has_default(self) -> bool:
        return self.default is not _UNSET


def utf16_order(text: str) -> bytes:
    """Sort key giving the order of UTF-16 code units."""
    return text.encode("utf-16-be", "surrogatepass")


def compile_transform(
    rules: Mapping[str, TransformRule | Mapping[str, Any]],
) -> tuple[tuple[str, TransformRule], ...]:
    """Rules in destination-path order; plain mappings use the keys from/cast/const/default."""
    compiled = []
    for destination in sorted(rules, key=utf16_order):
        check_dot_path(destination)
        rule = rules[destination]
        if not isinstance(rule, TransformRule):
            given = dict(rule)
            if "from" in given:
                given["source"] = given.pop("from")
            rule = TransformRule(**given)
        compiled.append((destination, rule))
    return tuple(compiled)


@dataclass(frozen=True)
class DestinationSpec:
    id: str
    url: str
    method: str = "POST"
    headers: Mapping[str, str] = field(default_factory=dict)
    retry: RetrySpec = RetrySpec()
    timeout_ms: int = 30_000
    success_statuses: Sequence[int] = ()
    persist_body: str = "TRUNCATED"
    filter: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(re.fullmatch(r"[a-z0-9][a-z0-9-]*", self.id) is not None, f"bad id '{self.id}'")
        _require(self.method in HTTP_METHODS, f"unknown method '{self.method}'")
        _in_range("timeout_ms", self.timeout_ms, 100, 300_000)
        for status in self.success_statuses:
            _in_range("success_statuses", status, 100, 599)
        _require(self.persist_body in BODY_RETENTION, f"unknown retention '{self.persist_body}'")
        compile_filter(self.filter)

    @property
    def lease_seconds(self) -> int:
        return math.ceil(self.timeout_ms * 3 / 1000) + 30


@dataclass(frozen=True)
class Pagination:
    param: str
    max_pages: int
    start: int = 1

    def __post_init__(self) -> None:
        _in_range("max_pages", self.max_pages, 1, MAX_PAGES)


@dataclass(frozen=True)
class PollSource:
    url: str
    query: Mapping[str, str] = field(default_factory=dict)
    timezone: str = DEFAULT_TIMEZONE
    pagination: Pagination | None = None
    items_path: str | None = None
    total_count_path: str | None = None

    kind = "http-poll"
    origin = "poll"


@dataclass(frozen=True)
class EndpointSource:
    path: str
    methods: Sequence[str] = ("POST",)
    items_path: str | None = None
    max_body_bytes: int = 1024 * 1024
    rate_per_minute: int | None = None

    kind = "http-endpoint"
    origin = "endpoint"

    def __post_init__(self) -> None:
        _require(
            re.fullmatch(r"/?(in/)?[a-z0-9][a-z0-9/_-]*", self.path) is not None
            and "//" not in self.path,
            f"bad route '{self.path}'",
        )
        head = re.sub(r"^in/", "", self.path.lstrip("/")).split("/")[0]
        _require(head not in RESERVED_ROUTES, f"route '{self.path}' is reserved")
        _require(len(self.methods) > 0, "at least one method")
        _require(all(m in ENDPOINT_METHODS for m in self.methods), "methods: POST, PUT, PATCH")
        _in_range("max_body_bytes", self.max_body_bytes, 1, MAX_BODY_BYTES)
        if self.rate_per_minute is not None:
            _in_range("rate_per_minute", self.rate_per_minute, 1, MAX_RATE_PER_MINUTE)

    @property
    def route(self) -> str:
        bare = re.sub(r"^in/", "", self.path.lstrip("/")).rstrip("/")
        return "/in/" + re.sub(r"/{2,}", "/", bare).lower()


@dataclass(frozen=True)
class FlowSpec:
    """One configured flow: where items come from, what is kept, where it goes."""

    id: str
    source: PollSource | EndpointSource
    dedupe: DedupeSpec
    transform: Mapping[str, Any]
    destinations: Sequence[DestinationSpec]
    filter: Mapping[str, Any] = field(default_factory=dict)
    enabled: bool = True

    def __post_init__(self) -> None:
        _require(re.fullmatch(r"[a-z0-9][a-z0-9-]*", self.id) is not None, f"bad id '{self.id}'")
        _require(len(self.destinations) > 0, "at least one destination")
        ids = [d.id for d in self.destinations]
        _require(len(ids) == len(set(ids)), "destination ids must be unique within a flow")
        compile_filter(self.filter)
        compile_transform(self.transform)
        if isinstance(self.source, PollSource):
            _require(self.dedupe.header is None, "dedupe.header only works for an endpoint")
            _require(len(self.dedupe.fields) > 0, "a poll source needs at least one dedupe field")
        else:
            _require(len(self.dedupe.alternatives) > 0, "give dedupe.header and/or dedupe.fields")
            _require(self.dedupe.on_missing is not None, "an endpoint must set dedupe.on_missing")

    @property
    def items_path(self) -> str | None:
        return self.source.items_path

    @property
    def filter_rules(self) -> tuple[FilterRule, ...]:
        return compile_filter(self.filter)

    @property
    def transform_rules(self) -> tuple[tuple[str, TransformRule], ...]:
        return compile_transform(self.transform)
