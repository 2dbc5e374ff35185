"""Status, listing, counters, audits and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.config import CONSUMER_BATCH, MAX_RETRIES, RETRY_DELAY_SECONDS
from tagloom.functions.predicates import is_tagged
from tagloom.sources.content import snippet_error

def _counts(snippets: DataFrame, tags: DataFrame) -> DataFrame:
    """Totals of both tables in one row, each table read once."""
    of_snippets = snippets.select("tags").agg(
        F.count("*").alias("total_snippets"),
        F.count_if(is_tagged(F.col("tags"))).alias("tagged_snippets"),
        F.lit(0).cast("bigint").alias("total_tags"),
    )
    of_tags = tags.agg(
        F.lit(0).cast("bigint").alias("total_snippets"),
        F.lit(0).cast("bigint").alias("tagged_snippets"),
        F.count("*").alias("total_tags"),
    )
    return of_snippets.unionByName(of_tags).agg(
        F.sum("total_snippets").alias("total_snippets"),
        F.sum("tagged_snippets").alias("tagged_snippets"),
        F.sum("total_tags").alias("total_tags"),
    )


def status(snippets: DataFrame, tags: DataFrame) -> DataFrame:
    untagged = F.col("total_snippets") - F.col("tagged_snippets")
    return _counts(snippets, tags).select(
        "total_snippets",
        "total_tags",
        "tagged_snippets",
        untagged.alias("untagged_snippets"),
        F.lit("active").alias("status"),
    )


def queue_status(snippets: DataFrame, tags: DataFrame) -> DataFrame:
    """Status with progress in percent, the consumer's settings, and hints.

    The hints name the backlog to enqueue and, as long as there is no tag at all,
    the vocabulary that has yet to grow.
    """
    counts = status(snippets, tags)
    ratio = F.col("tagged_snippets") / F.col("total_snippets") * 100
    percent = F.when(F.col("total_snippets") > 0, F.round(ratio, 1)).otherwise(0.0)
    waiting = F.col("untagged_snippets") > 0
    hints = F.filter(F.array(
        F.when(waiting, F.concat(
            F.lit("backlog() has "), F.col("untagged_snippets").cast("string"),
            F.lit(" snippets to enqueue"),
        )),
        F.when(F.col("total_tags") == 0, F.lit("no tag yet: the first batch makes them")),
    ), lambda h: h.isNotNull())
    return counts.select(
        "total_snippets",
        "total_tags",
        "tagged_snippets",
        "untagged_snippets",
        percent.alias("percent"),
        F.concat(percent.cast("string"), F.lit("%")).alias("progress"),
        F.col("untagged_snippets").alias("pending_snippets"),
        F.when(waiting, "processing").otherwise("idle").alias("status"),
        hints.alias("hints"),
        F.lit(CONSUMER_BATCH).alias("consumer_batch"),
        F.lit(MAX_RETRIES).alias("max_retries"),
        F.lit(RETRY_DELAY_SECONDS).alias("retry_delay_seconds"),
    )


def clear_summary(snippets: DataFrame, tags: DataFrame) -> DataFrame:
    """What clearing all tags would remove."""
    return _counts(snippets, tags).select(
        "total_tags", "tagged_snippets", "total_snippets"
    )


def list_tags(tags: DataFrame) -> DataFrame:
    """The vocabulary, most used first, ties by id."""
    return tags.select("id", "name", "created_at", "usage_count").orderBy(
        F.desc("usage_count"), "id"
    )


def usage_increments(assignments: DataFrame) -> DataFrame:
    """+1 per assigned proposal; repeats within a snippet count again."""
    return assignments.groupBy("tag_id").agg(F.count("*").alias("increment"))


def apply_usage(tags: DataFrame, increments: DataFrame) -> DataFrame:
    added = increments.select(F.col("tag_id").alias("id"), "increment")
    total = F.col("usage_count") + F.coalesce("increment", F.lit(0))
    return (
        tags.join(added, "id", "left")
        .withColumn("usage_count", total.cast("bigint"))
        .drop("increment")
    )


def usage_drift(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored counter against the number of snippets that hold the tag."""
    # the composite key makes pairs distinct per snippet; repeats are removed
    # before counting so that one hot tag is counted map-side
    held = (
        pairs.select("snippet_id", "tag_id").distinct()
        .groupBy(F.col("tag_id").alias("id"))
        .agg(F.count("*").alias("held_by"))
    )
    stored = tags.select("id", F.col("usage_count").alias("stored"))
    return (
        stored.join(held, "id", "full")
        .select(
            "id",
            F.coalesce("stored", F.lit(0)).alias("stored"),
            F.coalesce("held_by", F.lit(0)).alias("held_by"),
        )
        .withColumn("drift", F.col("stored") - F.col("held_by"))
    )


def run_stats(outcomes: DataFrame, total_tags: int | None = None) -> DataFrame:
    """One row about a run from its outcome table.

    ``outcomes`` has one row per snippet tried: ``id, error, new_tags,
    existing_tags``. A snippet that failed is not processed but still moves the
    last id on.
    """
    report = outcomes.agg(
        F.count_if(F.col("error").isNull()).alias("processed_snippets"),
        F.coalesce(F.sum("new_tags"), F.lit(0)).alias("new_tags_created"),
        F.coalesce(F.sum("existing_tags"), F.lit(0)).alias("existing_tags_used"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.max("id").alias("last_processed_id"),
    )
    if total_tags is None:
        return report
    return report.withColumn("total_tags", F.lit(total_tags).cast("bigint"))


def run_errors(outcomes: DataFrame) -> DataFrame:
    """One row per failed snippet; never gathered into one list."""
    failed = outcomes.where(F.col("error").isNotNull())
    return failed.select("id", snippet_error(F.col("id"), F.col("error")).alias("error"))


def chunk_totals(chunked_outcomes: DataFrame) -> DataFrame:
    return chunked_outcomes.groupBy("chunk").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed")
    )
