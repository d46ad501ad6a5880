"""Continuous delivery state with backoff timers."""

from __future__ import annotations

from collections import defaultdict, namedtuple
from collections.abc import Iterable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.functions import retry
from sluice.operators.delivery import OPEN, with_destination
from sluice.spec import FlowSpec

STATE_SCHEMA = "status string, attempts int"
INITIAL_SCHEMA = "delivery_id string, status string, attempts int, due_ms bigint"
FINISHED = ("DELIVERED", "DISCARDED")
CHANGE_SCHEMA = "delivery_id string, at_ms bigint, status string, attempts int, reason string, due_ms bigint"
CHANGE_COLUMNS = ("delivery_id", "at_ms", "status", "attempts", "reason", "due_ms")
CHANGE = Row(*CHANGE_COLUMNS)
RESULT = namedtuple("RESULT", "delivery_id at_ms kind why max_attempts delays")
SHARE_SCHEMA = "ids array<string>, statuses array<string>, attempts array<int>, timers_ms array<bigint>"


def after_results(delivery: str | None, status: str, attempts: int, results: Iterable, forget_ms: int) -> tuple[str, int, int | None, list[tuple]]:
    """Status, attempts and timer of a delivery after results of its own, and the change each one that counts makes.

    Results are already classified and timed by column expressions; here the
    count is kept, the limit applied, and the time of the next attempt chosen.
    """
    timer, changes = None, []
    # a delivery has at most max_attempts results that count
    for row in sorted(results, key=lambda r: (r.at_ms is None, r.at_ms or 0, r.kind)):
        if status in FINISHED:
            break
        attempts += 1
        due, reason = None, None
        if row.kind == retry.SUCCESS:
            status = "DELIVERED"
        elif row.kind == retry.NON_RETRYABLE:
            status, reason = "DISCARDED", "NON_RETRYABLE_STATUS"
        elif row.max_attempts is not None and attempts >= row.max_attempts:
            status, reason = "DISCARDED", "ATTEMPTS_EXHAUSTED"
        else:
            delays = row.delays
            status, reason = "FAILED", row.why
            due = row.at_ms + delays[min(attempts, len(delays)) - 1]
        timer = due if due is not None else row.at_ms + forget_ms
        changes.append((delivery, row.at_ms, status, attempts, reason, due))
    return status, attempts, timer, changes


class DeliveryProcessor(StatefulProcessor):
    """State of one delivery: its status and how often it was tried.

    A timer is set for the next attempt. The state of a finished delivery stays
    for `forget_ms`, so a late result cannot open it again, and is then removed
    by its timer. Keys are many and rows per key few, so rows are taken and
    given as rows, not as a frame per key.
    """

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", STATE_SCHEMA)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        # one row per delivery; an attempt that was already due is handed out with the first watermark
        self.state.update((initialState.status, initialState.attempts))
        if initialState.due_ms is not None:
            self.handle.registerTimer(initialState.due_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()  # asking the state store is what a delivery costs, so each question is asked once
        status, attempts, timer, changes = after_results(key[0], *(known or ("PENDING", 0)), rows, self.forget_ms)
        if not changes:
            return
        for change in changes:
            yield CHANGE(*change)
        if known:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        self.handle.registerTimer(timer)
        self.state.update((status, attempts))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts = self.state.get() or ("", 0)
        if status in FINISHED:
            self.state.clear()
        else:
            due = int(expiredTimerInfo.getExpiryTimeInMs())
            yield CHANGE(key[0], due, "DUE", attempts, None, due)

    def close(self) -> None:
        pass


class DeliveryShares(StatefulProcessor):
    """State of a share of all deliveries, with what `DeliveryProcessor` keeps for each of them.

    A question to the state store costs the same for a share as for a delivery,
    so a share is read, written and timed once for all its results. Its one
    timer is that of the delivery that comes next; those of equal or earlier
    time than the watermark are all handled when it expires.
    """

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shares", SHARE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = self._known()
        before = _next_timer(known)
        columns = (_plain(initialState["delivery_id"]), _plain(initialState["status"]), _numbers(initialState["attempts"]), _numbers(initialState["due_ms"]))
        known.update((delivery, (status, attempts, due)) for delivery, status, attempts, due in zip(*columns))
        self._keep(known, before)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        results = defaultdict(list)
        for frame in rows:
            columns = (_plain(frame["delivery_id"]), _numbers(frame["at_ms"]), _plain(frame["kind"]), _plain(frame["why"]), _numbers(frame["max_attempts"]), frame["delays"])
            for row in map(RESULT._make, zip(*columns)):
                results[row.delivery_id].append(row)
        known = self._known()
        before, found = _next_timer(known), []
        for delivery, mine in results.items():
            status, attempts, _ = known.get(delivery, ("PENDING", 0, None))
            status, attempts, timer, changes = after_results(delivery, status, attempts, mine, self.forget_ms)
            if changes:
                known[delivery] = (status, attempts, int(timer))
                found += changes
        if found:
            self._keep(known, before)
            yield _changes(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        left, found = {}, []
        for delivery, (status, attempts, timer) in self._known().items():
            if timer is None or timer > until:
                left[delivery] = (status, attempts, timer)
            elif status not in FINISHED:
                left[delivery] = (status, attempts, None)
                found.append((delivery, timer, "DUE", attempts, None, timer))
        self._keep(left, None)  # the timer that expired goes by itself
        if found:
            yield _changes(found)

    def close(self) -> None:
        pass

    def _known(self) -> dict[str | None, tuple[str, int, int | None]]:
        ids, *kept = self.state.get() or ((), (), (), ())
        return dict(zip(ids, zip(*kept)))

    def _keep(self, known: dict[str | None, tuple[str, int, int | None]], before: int | None) -> None:
        after = _next_timer(known)
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is not None and before != after:
            self.handle.registerTimer(after)
        if known:
            self.state.update((list(known), *map(list, zip(*known.values()))))
        else:
            self.state.clear()


def _next_timer(known: dict[str | None, tuple[str, int, int | None]]) -> int | None:
    return min((timer for _, _, timer in known.values() if timer is not None), default=None)


def _plain(column: pd.Series) -> list:
    """Texts of a column; what is missing is None, whatever pandas made of it."""
    return [v if isinstance(v, str) else None for v in column.tolist()]


def _numbers(column: pd.Series) -> list[int | None]:
    """Whole numbers of a column, which pandas holds as floats where one is missing."""
    return [None if v is None or v != v else int(v) for v in column.tolist()]


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=CHANGE_COLUMNS, dtype=object)


def known_states(deliveries: DataFrame) -> DataFrame:
    """State to start a stream from: the open deliveries of a store, with the next attempt of those that wait for one."""
    waits = F.when(F.col("status") == "FAILED", F.unix_millis("next_attempt_at"))
    return deliveries.filter(F.col("status").isin(*OPEN)).select(
        F.col("id").alias("delivery_id"), "status", F.col("attempt_count").alias("attempts"), waits.alias("due_ms")
    )


def delivery_state_stream(
    outcomes: DataFrame,
    specs: Sequence[FlowSpec],
    late: str = "10 minutes",
    forget: timedelta = timedelta(days=1),
    known: DataFrame | None = None,
    shares: int | None = None,
) -> DataFrame:
    """Stream of status changes per delivery; a `DUE` row when its next attempt is due.

    `known` (see `known_states`) is what the first start of the stream begins with.
    Finished deliveries are forgotten `forget` after they ended, in event time.

    The changes are the same with one state per delivery and with all deliveries
    dealt by hash to `shares` states. One each suits a stream that brings few
    results at a time; shares suit one that brings many, as each share with a
    result is read and written whole. A stream keeps the number it started with.

    `outcomes` needs delivery_id, pipeline_id, destination_id, max_attempts, finished_at,
    net_code, status, headers. Event time is `finished_at`; timers fire when the
    watermark passes them. Needs the RocksDB state store.
    """
    judged = with_destination(outcomes, specs, "inner")
    verdict = retry.classify(F.col("net_code"), F.col("status"), F.col("success_statuses"))
    wait = retry.retry_after_ms(F.col("headers")["retry-after"], F.col("finished_at"))
    # the attempt is only known to the state, so the delay of each possible one goes along; the header is read once for all
    attempts = F.sequence(F.lit(1), F.greatest(F.col("max_attempts"), F.lit(1)))
    delays = F.get(
        F.transform(
            F.array(wait),
            lambda asked: F.transform(
                attempts,
                lambda attempt: retry.backoff_ms(
                    attempt,
                    F.col("retry_initial_ms"),
                    F.col("retry_max_ms"),
                    F.col("retry_factor"),
                    F.col("retry_jitter"),
                    F.col("retry_exponential"),
                    asked,
                    retry.unit_draw(F.col("delivery_id"), attempt.cast("string")),
                ),
            ),
        ),
        F.lit(0),
    )
    rows = judged.withWatermark("finished_at", late).select(
        "delivery_id",
        "finished_at",
        F.unix_millis("finished_at").alias("at_ms"),
        verdict["kind"].alias("kind"),
        verdict["why"].alias("why"),
        "max_attempts",
        delays.alias("delays"),
    )
    forget_ms = int(forget.total_seconds() * 1000)
    if shares is None:
        return rows.groupBy("delivery_id").transformWithState(
            statefulProcessor=DeliveryProcessor(forget_ms),
            outputStructType=CHANGE_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
            initialState=None if known is None else known.groupBy("delivery_id"),
        )
    share = F.pmod(F.xxhash64("delivery_id"), F.lit(shares)).alias("share")
    return rows.select("*", share).groupBy("share").transformWithStateInPandas(
        statefulProcessor=DeliveryShares(forget_ms),
        outputStructType=CHANGE_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if known is None else known.select("*", share).groupBy("share"),
    )
