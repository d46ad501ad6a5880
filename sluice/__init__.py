"""sluice: event intake and delivery bookkeeping as Spark DataFrame operations."""

from sluice.session import build_session, configure
from sluice.spec import (
    DedupeSpec,
    DestinationSpec,
    EndpointSource,
    FlowSpec,
    Pagination,
    PollSource,
    RetrySpec,
    TransformRule,
)

__all__ = [
    "build_session",
    "configure",
    "DedupeSpec",
    "DestinationSpec",
    "EndpointSource",
    "FlowSpec",
    "Pagination",
    "PollSource",
    "RetrySpec",
    "TransformRule",
]
