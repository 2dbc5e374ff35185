"""Backlog and progress of queueing, derived from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import CHUNK_SIZE
from tagloom.functions.predicates import after, is_untagged


def backlog(
    snippets: DataFrame, in_flight: DataFrame | None = None, cursor: str | None = None
) -> DataFrame:
    """Untagged snippets behind ``cursor`` that are not queued already.

    Failed ids are not in flight, so they always come back. ``in_flight`` has
    ``snippet_id`` and may hold repeats.
    """
    rows = after(snippets.where(is_untagged(F.col("tags"))), cursor)
    if in_flight is None:
        return rows
    queued = in_flight.select(F.col("snippet_id").alias("id")).distinct()
    return rows.join(queued, "id", "left_anti")


def progress(
    chunked: DataFrame,
    outcomes: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    started_at: Column | None = None,
    error_message: str | None = None,
) -> DataFrame:
    """The progress record, one row.

    ``chunked`` is the chunked backlog (``id, chunk``), ``outcomes`` has ``id,
    ok`` per id that was tried to queue. A chunk counts as processed once any of
    its ids was tried; resuming starts behind the last success.
    """
    tried = chunked.select("id", "chunk").join(outcomes.select("id", "ok"), "id", "left")
    totals = tried.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("ok")).alias("queued"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.max("chunk"), F.lit(0)).alias("total_chunks"),
        F.coalesce(
            F.max(F.when(F.col("ok").isNotNull(), F.col("chunk"))), F.lit(0)
        ).alias("processed_chunks"),
        F.max(F.when(F.col("ok"), F.col("id"))).alias("last_processed_id"),
    )
    done = F.col("processed_chunks") >= F.col("total_chunks")
    state = F.when(done, "completed").otherwise("processing")
    if error_message is not None:
        state = F.lit("error")
    return totals.select(
        "total", "queued", "failed",
        state.alias("status"),
        F.lit(chunk_size).cast("bigint").alias("chunk_size"),
        F.when(F.col("total_chunks") > 0, F.col("processed_chunks") + 1)
        .otherwise(0).cast("bigint").alias("current_chunk"),
        "total_chunks", "processed_chunks",
        "last_processed_id",
        F.col("last_processed_id").alias("resume_from_id"),
        F.lit(error_message).cast("string").alias("error_message"),
        (started_at if started_at is not None else F.lit(None))
        .cast("timestamp").alias("started_at"),
    )
