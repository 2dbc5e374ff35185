"""Applying a merge mapping to junction, arrays, counters and names.

``mapping`` names each merged tag once with its primary tag, so every table is
rewritten in one pass. It is as small as the vocabulary; written through
``materialize`` its size is known and Spark picks a broadcast by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.codec import tags_from_json, tags_to_json
from tagloom.session import materialize


def _targets(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("merge_id").alias("tag_id"), "primary_id")


def merge_forest(before: DataFrame, mapping: DataFrame) -> DataFrame:
    """``merge_id, primary_id``: what every merged tag stands for after ``mapping``.

    ``before`` is the forest so far. Pointers are doubled until none moves, which takes
    as many rounds as the longest chain has binary digits. A chain that is longer than
    there are merges is a circle and is refused. An id merges once; later mentions of it
    are left out.
    """
    new = mapping.select("merge_id", "primary_id").dropDuplicates(["merge_id"])
    old = before.select("merge_id", "primary_id").dropDuplicates(["merge_id"])
    forest = materialize(
        old.unionByName(new.join(old.select("merge_id"), "merge_id", "left_anti")), "forest"
    )
    for _ in range(forest.count().bit_length() + 1):
        onward = forest.select(
            F.col("merge_id").alias("primary_id"), F.col("primary_id").alias("beyond")
        )
        forest = materialize(
            forest.select("merge_id", "primary_id").join(onward, "primary_id", "left").select(
                "merge_id", F.coalesce("beyond", "primary_id").alias("primary_id"),
                F.col("beyond").isNotNull().alias("moved"),
            ),
            "forest",
        )
        if forest.where(F.col("moved") | (F.col("merge_id") == F.col("primary_id"))).isEmpty():
            return forest.select("merge_id", "primary_id")
    some = [r["merge_id"] for r in forest.where("moved").orderBy("merge_id").limit(5).collect()]
    raise ValueError(f"tags merge in a circle, among them {some}")


def remap_pairs(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Junction with merged tags replaced by their primary tag.

    Only rows that change can collide, so the others are not shuffled: changed
    rows are made distinct and added where the pair is not there already.
    """
    targets = _targets(mapping)
    kept = pairs.join(targets.select("tag_id"), "tag_id", "left_anti").select(
        "snippet_id", "tag_id"
    )
    moved = (
        pairs.join(targets, "tag_id")
        .select("snippet_id", F.col("primary_id").alias("tag_id"))
        .distinct()
    )
    primaries = targets.select(F.col("primary_id").alias("tag_id")).distinct()
    present = kept.join(primaries, "tag_id", "left_semi")
    new = moved.join(present, ["snippet_id", "tag_id"], "left_anti")
    return kept.unionByName(new)


def touched(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``snippet_id`` with every merged tag it holds and where the plan names it."""
    at = F.struct("reply_no", "group_no", "pos").alias("at")
    targets = mapping.select(F.col("merge_id").alias("tag_id"), "primary_id", at)
    return pairs.join(targets, "tag_id").select("snippet_id", "tag_id", "primary_id", "at")


def rewrite_arrays(
    snippets: DataFrame, pairs: DataFrame, mapping: DataFrame
) -> DataFrame:
    """Snippets with merged ids dropped and missing primary ids appended.

    Only snippets that hold a merged tag through the junction change; primaries
    are appended in plan order. NULL and corrupt lists stay as they are.
    """
    step = F.struct("at", "tag_id", "primary_id")
    changes = (
        touched(pairs, mapping).groupBy("snippet_id")
        .agg(F.sort_array(F.collect_set(step)).alias("steps"))
        .select(
            F.col("snippet_id").alias("id"),
            F.transform("steps", lambda s: s["tag_id"]).alias("gone"),
            F.array_distinct(F.transform("steps", lambda s: s["primary_id"])).alias("heads"),
        )
    )
    joined = snippets.join(changes, "id", "left")
    old = tags_from_json(F.col("tags"))
    kept = F.filter("old", lambda t: ~F.array_contains("gone", t))
    added = F.filter("heads", lambda t: ~F.array_contains("old", t))
    new = tags_to_json(F.concat(kept, added))
    changed = F.col("gone").isNotNull() & F.col("old").isNotNull()
    return (
        joined.withColumn("old", old)
        .withColumn("tags", F.when(changed, new).otherwise(F.col("tags")))
        .select(*snippets.columns)
    )


def rollup_usage(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vocabulary after the merge: primaries gain the counts, merged tags go."""
    targets = _targets(mapping).withColumnRenamed("tag_id", "id")
    gains = (
        tags.join(targets, "id").groupBy(F.col("primary_id").alias("id"))
        .agg(F.sum("usage_count").alias("gain"))
    )
    kept = tags.join(targets.select("id"), "id", "left_anti")
    total = F.col("usage_count") + F.coalesce("gain", F.lit(0))
    return (
        kept.join(gains, "id", "left")
        .withColumn("usage_count", total.cast("bigint"))
        .select(*tags.columns)
    )


def rename_tags(tags: DataFrame, applied: DataFrame) -> DataFrame:
    """Vocabulary with accepted renames (``primary_id, new_name, verdict``)."""
    new = applied.where(F.col("verdict") == "rename").select(
        F.col("primary_id").alias("id"), "new_name"
    )
    return (
        tags.join(new, "id", "left")
        .withColumn("name", F.coalesce("new_name", "name"))
        .select(*tags.columns)
    )


def consolidation_report(
    mapping: DataFrame, pairs: DataFrame, snippets: DataFrame
) -> DataFrame:
    """Per group: primary tag, merged tags, rewritten (snippet, tag) pairs, reason."""
    readable = snippets.where(tags_from_json(F.col("tags")).isNotNull()).select(
        F.col("id").alias("snippet_id")
    )
    rewritten = (
        touched(pairs, mapping).join(readable, "snippet_id", "left_semi")
        .groupBy("at.reply_no", "at.group_no")
        .agg(F.count("*").alias("snippets_updated"))
    )
    merged = F.sort_array(F.collect_list(F.struct("pos", "merge_id")))
    groups = mapping.groupBy("reply_no", "group_no", "primary_id", "primary_name", "reason").agg(
        F.transform(merged, lambda m: m["merge_id"]).alias("merged_ids")
    )
    return (
        groups.join(rewritten, ["reply_no", "group_no"], "left")
        .withColumn("snippets_updated", F.coalesce("snippets_updated", F.lit(0)))
    )
