"""What happens to a message after its snippet was tried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.config import (
    BACKOFF_BASE_SECONDS,
    BACKOFF_CAP_SECONDS,
    MAX_RETRIES,
    RETRY_DELAY_SECONDS,
)

# --- fixed values: texts that tell error kinds apart, first hit wins ----------
CAPACITY_MARKS = ("3040", "Capacity temporarily exceeded")
RATE_LIMIT_MARKS = ("Too many API requests", "rate limit", "429")
TRANSIENT_MARKS = ("timeout", "network", "503")
MISSING_MARKS = ("not found",)
RATE_LIMIT_DELAY_SECONDS = 60
# ----------------------------------------------------------------------------

ACK, RETRY, DEAD = "ack", "retry", "dead_letter"


def backoff_seconds(attempts: Column) -> Column:
    """Doubling delay, capped; a missing or zero attempt counts as the first."""
    attempt = F.when(F.coalesce(attempts, F.lit(0)) == 0, 1).otherwise(attempts)
    delay = F.lit(BACKOFF_BASE_SECONDS) * F.pow(F.lit(2.0), attempt - 1)
    return F.least(F.lit(float(BACKOFF_CAP_SECONDS)), delay).cast("bigint")


def _mentions(message: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | message.contains(mark)
    return found


def error_kind(message: Column) -> Column:
    """Kind of an error text; a failure without text is ``unknown``."""
    return (
        F.when(message.isNull(), "unknown")
        .when(_mentions(message, CAPACITY_MARKS), "capacity")
        .when(_mentions(message, RATE_LIMIT_MARKS), "rate_limit")
        .when(_mentions(message, TRANSIENT_MARKS), "transient")
        .when(_mentions(message, MISSING_MARKS), "missing")
        .otherwise("other")
    )


def classify_error(message: Column, attempts: Column) -> Column:
    """``struct(kind, action, delay_seconds)`` for a failed message."""
    kind = error_kind(message)
    action = F.when(kind == "missing", ACK).otherwise(RETRY)
    delay = (
        F.when(kind == "missing", F.lit(None))
        .when(kind == "capacity", backoff_seconds(attempts))
        .when(kind == "rate_limit", F.lit(RATE_LIMIT_DELAY_SECONDS))
        .otherwise(F.lit(RETRY_DELAY_SECONDS))
        .cast("bigint")
    )
    return F.struct(
        kind.alias("kind"), action.alias("action"), delay.alias("delay_seconds")
    )


def final_action(
    action: Column, attempts: Column, max_retries: int = MAX_RETRIES
) -> Column:
    """Turns a retry into a dead letter once the retries are used up.

    The first delivery is attempt 1, so ``max_retries`` retries end with
    attempt ``max_retries + 1``.
    """
    used_up = F.coalesce(attempts, F.lit(1)) > max_retries
    return F.when((action == RETRY) & used_up, DEAD).otherwise(action)
