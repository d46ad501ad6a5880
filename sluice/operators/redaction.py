"""Masking applied to audit tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.redact import scrub


def mask_error(rows: DataFrame, secrets: Iterable[str] = (), column: str = "error_message") -> DataFrame:
    """Scrub the message of audit rows and keep at most 2000 characters; the code stays."""
    return rows.withColumn(column, F.substring(scrub(F.col(column), secrets), 1, M.MAX_MESSAGE))
