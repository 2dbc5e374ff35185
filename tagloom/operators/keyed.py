"""Keyed writes as set operations on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_rows(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not in ``base`` yet, one per key."""
    fresh = new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return fresh.select(*base.columns)


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` plus the rows of ``new`` whose key is not there yet."""
    return base.unionByName(fresh_rows(base, new, keys))


def snippets_with_tags(snippets: DataFrame, pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """Snippets holding any of the given tags."""
    holders = pairs.join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return snippets.join(
        holders.select(F.col("snippet_id").alias("id")), "id", "left_semi"
    )


def replace_pairs(
    pairs: DataFrame, processed: DataFrame, assignments: DataFrame
) -> DataFrame:
    """Junction after a run: processed snippets hold exactly their new tags."""
    done = processed.select(F.col("id").alias("snippet_id"))
    kept = pairs.join(done, "snippet_id", "left_anti")
    new = assignments.select(F.col("id").alias("snippet_id"), "tag_id").distinct()
    return kept.unionByName(new)


def snippet_arrays(processed: DataFrame, assignments: DataFrame) -> DataFrame:
    """``id, tag_ids`` per processed snippet, in proposal order.

    Repeats are kept, and a snippet without any tag gets an empty list. Lists
    are as long as a snippet has proposals, which the proposer limits.
    """
    lists = assignments.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "tag_id"))).alias("_ordered")
    )
    ids = F.transform("_ordered", lambda p: p["tag_id"])
    empty = F.array().cast("array<bigint>")
    return (
        processed.select("id").join(lists, "id", "left")
        .select("id", F.coalesce(ids, empty).alias("tag_ids"))
    )


def update_tags_column(snippets: DataFrame, arrays: DataFrame) -> DataFrame:
    """Rows with a new list get it; all others keep their value."""
    new = arrays.select("id", F.to_json("tag_ids").alias("_new"))
    return (
        snippets.join(new, "id", "left")
        .withColumn("tags", F.coalesce("_new", "tags"))
        .drop("_new")
        .select(*snippets.columns)
    )
