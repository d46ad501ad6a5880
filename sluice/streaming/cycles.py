"""Pages of one poll cycle that land in several micro-batches, in any order.

The pages wait in keyed state until nothing has come for their cycle for a while, in event time. Then the whole cycle is
handed on in page order, in one micro-batch, where the page cuts of `sluice.sources.pages` see all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType


class CycleHolder(StatefulProcessor):
    """Holds the pages of one cycle by number; a page that comes twice counts once, as it came last."""

    def __init__(self, columns: list[str], value_schema: str, wait_ms: int) -> None:
        self.columns, self.value_schema, self.wait_ms = columns, value_schema, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", self.value_schema)
        self.last = handle.getValueState("last", "at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        for frame in rows:
            for row in frame.itertuples(index=False):
                values = tuple(None if pd.isna(v) else v for v in (getattr(row, c) for c in self.columns))
                self.pages.updateValue((int(row.page),), values)
                last = max(last, int(row.at_ms))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer(last + self.wait_ms)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted((page[0], tuple(values)) for page, values in self.pages.iterator())
        self.pages.clear()
        self.last.clear()
        yield self._rows([(key[0], page, *values) for page, values in held])

    def close(self) -> None:
        pass

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["cycle_id", "page", *self.columns]).astype(object)


def hold_cycles(pages: DataFrame, wait: timedelta = timedelta(minutes=10), late: str = "10 minutes") -> DataFrame:
    """Landed pages (cycle_id, page, fetched_at, ...) with each cycle whole: it comes once the watermark, which lags by
    `late`, is `wait` past its last page. A cycle has at most as many pages as its flow may fetch, so state is bounded."""
    kinds = {f.name: f.dataType for f in pages.schema}
    moments = [c for c, t in kinds.items() if isinstance(t, TimestampType)]
    columns = [c for c in pages.columns if c not in ("cycle_id", "page")]
    types = {c: "bigint" if c in moments else kinds[c].simpleString() for c in columns}
    value_schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    rows = pages.withWatermark("fetched_at", late).select(
        "*", F.unix_millis("fetched_at").alias("at_ms")
    )
    plain = rows.select(
        "cycle_id", "page", "at_ms", F.col("fetched_at").alias("event_time"),
        *[F.unix_micros(c).alias(c) if c in moments else F.col(c) for c in columns],
    )
    held = plain.groupBy("cycle_id").transformWithStateInPandas(
        statefulProcessor=CycleHolder(columns, value_schema, int(wait.total_seconds() * 1000)),
        outputStructType=f"cycle_id {kinds['cycle_id'].simpleString()}, page int, {value_schema}",
        outputMode="Append",
        timeMode="EventTime",
    )
    given: StructType = pages.schema
    return held.select(*[F.timestamp_micros(f.name).alias(f.name) if f.name in moments else F.col(f.name).cast(f.dataType) for f in given])
