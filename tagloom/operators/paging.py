"""Keyset and offset pages, and numbering without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.config import BATCH_SIZE, CHUNK_SIZE, CONSUMER_BATCH
from tagloom.functions.predicates import after, is_untagged
from tagloom.session import materialize

# monotonically_increasing_id() keeps the row's place in its partition in the
# lower 33 bits and the partition number above them.
POSITION_BITS = 33


def next_page(
    snippets: DataFrame, size: int = BATCH_SIZE, cursor: str | None = None
) -> DataFrame:
    """The next ``size`` untagged snippets behind ``cursor``, in id order."""
    open_rows = after(snippets.where(is_untagged(F.col("tags"))), cursor)
    return open_rows.orderBy("id").limit(size)


def page_cursor(page: DataFrame) -> DataFrame:
    """Where the next page starts: the last id, whether or not it succeeded."""
    return page.agg(F.max("id").alias("next_cursor"), F.count("*").alias("n_rows"))


def offset_page(snippets: DataFrame, size: int, offset: int) -> DataFrame:
    open_rows = snippets.where(is_untagged(F.col("tags")))
    return open_rows.orderBy("id").offset(offset).limit(size)


def numbered(df: DataFrame, key: str = "id", name: str = "row_no") -> DataFrame:
    """Global 1-based row numbers in ``key`` order.

    Rows are range partitioned and sorted; each keeps its place within its
    partition. Only the row count per partition is brought together, so no task
    ever sees more than its own range. The numbered rows are written once,
    because the ranges come from sampling and must not be drawn a second time.
    """
    spot = F.monotonically_increasing_id()
    placed = materialize(
        df.repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .withColumn("_spot", spot),
        "numbered",
    )
    part = F.shiftright("_spot", POSITION_BITS)
    place = F.col("_spot").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    placed = placed.withColumn("_part", part).withColumn("_place", place)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # one row per shuffle partition, hence always small
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_place") + 1)
        .drop("_spot", "_part", "_place", "_start")
    )


def assign_chunks(df: DataFrame, size: int = CHUNK_SIZE, key: str = "id") -> DataFrame:
    """Adds ``row_no`` and the 1-based ``chunk`` of ``size`` rows it falls in."""
    chunk = F.floor((F.col("row_no") - 1) / size) + 1
    return numbered(df, key).withColumn("chunk", chunk.cast("bigint"))


def chunk_plan(df: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """First and last id and row count of every chunk."""
    return (
        assign_chunks(df.select("id"), size)
        .groupBy("chunk")
        .agg(
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
            F.count("*").alias("n_rows"),
        )
    )


def batches_of(df: DataFrame, size: int = CONSUMER_BATCH) -> DataFrame:
    """Ordered lists of at most ``size`` ids."""
    return (
        assign_chunks(df.select("id"), size)
        .groupBy("chunk")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("chunk").alias("batch"), "ids")
    )
