"""Attempt classification, Retry-After and backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice import messages as M
from sluice.functions.casts import parse_instant
from sluice.functions.variants import js_trim, number_of_text, rarely

SUCCESS = "SUCCESS"
RETRYABLE = "RETRYABLE"
NON_RETRYABLE = "NON_RETRYABLE"


def classify(network_code: Column, status: Column, success_statuses: Column) -> Column:
    """struct(kind, why) of one attempt.

    `network_code` is set when no response came; `success_statuses` is the
    destination's list, empty for "any 2xx".
    """
    listed = F.coalesce(F.array_contains(success_statuses, status), F.lit(False))
    no_list = F.coalesce(F.size(success_statuses), F.lit(0)) <= 0
    code = F.concat(F.lit("HTTP_"), status.cast("string"))

    def result(kind: str, why: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), why.alias("why"))

    nothing = F.lit(None).cast("string")
    return (
        F.when(network_code.isNotNull(), result(RETRYABLE, network_code))
        .when(listed, result(SUCCESS, nothing))
        .when(status.between(200, 299) & no_list, result(SUCCESS, nothing))
        .when(
            status.between(200, 299),
            result(NON_RETRYABLE, F.concat(code, F.lit(M.OUTSIDE_SUCCESS_LIST))),
        )
        .when(status.between(300, 399), result(NON_RETRYABLE, F.concat(code, F.lit(M.REDIRECT))))
        .when(status.between(400, 499) & ~status.isin(408, 429), result(NON_RETRYABLE, code))
        .otherwise(result(RETRYABLE, code))
    )


def http_date(text: Column) -> Column:
    """TIMESTAMP of an HTTP date such as `Sun, 06 Nov 1994 08:49:37 GMT`."""
    core = F.regexp_extract(
        text, "^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1
    )
    return F.try_to_timestamp(core, F.lit("dd MMM yyyy HH:mm:ss"))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds a Retry-After header asks for (DOUBLE); NULL when it asks for nothing."""

    def read(text: Column) -> Column:
        seconds = F.when(text == "", F.lit(0.0)).otherwise(number_of_text(text))
        until = F.coalesce(http_date(text), parse_instant(text))
        wait = (F.unix_millis(until) - F.unix_millis(now)).cast("double")
        asked = F.coalesce(seconds * 1000, wait)
        return F.when(asked.isNotNull(), F.greatest(asked, F.lit(0.0)))

    return rarely(header.isNotNull(), js_trim(header), read)


def unit_draw(*material: Column) -> Column:
    """A number in [0, 1) that depends only on the material (repeatable jitter)."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", *material), 256), 1, 12), 16, 10)
    return bits.cast("double") / F.lit(float(16**12))


def backoff_ms(
    attempt: Column,
    initial_ms: Column,
    max_ms: Column,
    factor: Column,
    jitter: Column,
    exponential: Column,
    retry_after: Column,
    draw: Column,
) -> Column:
    """Delay before the next attempt (BIGINT ms); `attempt` counts from 1."""
    zero, top = F.lit(0.0), max_ms.cast("double")

    def bounded(value: Column) -> Column:
        return F.least(F.greatest(value, zero), top)

    exponent = F.when(exponential, F.greatest(attempt - 1, F.lit(0))).otherwise(F.lit(0))
    base = bounded(initial_ms.cast("double") * F.pow(factor, exponent))
    spread = bounded(base * (1 - jitter + draw * 2 * jitter))
    delay = F.when(jitter > 0, spread).otherwise(base)
    return (
        F.when(retry_after.isNotNull(), bounded(retry_after))
        .otherwise(F.floor(delay + 0.5))
        .cast("bigint")
    )
