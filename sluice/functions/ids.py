"""Time-ordered identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7_of(at: Column, *material: Column) -> Column:
    """UUID version 7 text: 48 bits of epoch milliseconds, then bits of sha256(material).

    The tail comes from the material instead of a random source, so a replayed
    batch gives the same ids.
    """
    tail = F.sha2(F.concat_ws("|", *material), 256)
    millis = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    variant = F.substring(
        F.lit("89ab"),
        (F.conv(F.substring(tail, 4, 1), 16, 10).cast("int") % 4) + 1,
        F.lit(1),
    )
    return F.concat_ws(
        "-",
        F.substring(millis, 1, 8),
        F.substring(millis, 9, 4),
        F.concat(F.lit("7"), F.substring(tail, 1, 3)),
        F.concat(variant, F.substring(tail, 5, 3)),
        F.substring(tail, 8, 12),
    )
