"""Outcome of each message: acknowledge, retry later, or dead letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import MAX_RETRIES, MESSAGE_PRIORITY
from tagloom.functions.errors import ACK, RETRY, classify_error, final_action


def route(
    outcomes: DataFrame, now_ms: int | Column, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """Adds ``kind, action, delay_seconds, next_at`` to ``failed, error, attempts``.

    ``failed`` tells a failure without a text from a success. ``next_at`` is when
    a retry is due, in milliseconds.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    judged = outcomes.withColumn("_c", classify_error(F.col("error"), F.col("attempts")))
    action = final_action(F.col("_c.action"), F.col("attempts"), max_retries)
    failed = F.col("failed")
    return (
        judged
        .withColumn("kind", F.when(failed, F.col("_c.kind")))
        .withColumn("action", F.when(failed, action).otherwise(ACK))
        .withColumn(
            "delay_seconds", F.when(F.col("action") == RETRY, F.col("_c.delay_seconds"))
        )
        .withColumn("next_at", (now + F.col("delay_seconds") * 1000).cast("bigint"))
        .drop("_c")
    )


def retry_messages(routed: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """Messages to queue again: retries that came due in a span of time.

    ``routed`` has ``run``, or ``timestamp`` of first deliveries.
    """
    run = "run" if "run" in routed.columns else "timestamp"
    due = routed.where(
        (F.col("action") == RETRY)
        & (F.col("next_at") > since_ms) & (F.col("next_at") <= until_ms)
    )
    return due.select(
        "snippet_id",
        F.lit(until_ms).cast("bigint").alias("timestamp"),
        F.lit(MESSAGE_PRIORITY).alias("priority"),
        (F.coalesce("attempts", F.lit(1)) + 1).cast("int").alias("attempts"),
        F.col(run).cast("bigint").alias("run"),
    )
