"""Growth of the tag vocabulary and the tag of every proposal.

Growth is defined one proposal after the other: a proposal uses its best tag so
far, else becomes a tag itself while there is room. As a set operation: distinct
new names that resemble no existing tag, ordered by first occurrence, contribute
their first-come leaders up to the limit. Work on similarity is done on distinct
names only; occurrences are joined back by name at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.config import MAX_TAGS, SIMILARITY_THRESHOLD
from tagloom.functions.similarity import allowed_edits
from tagloom.operators.leaders import followers
from tagloom.operators.matching import fuzzy_pairs, longest_name
from tagloom.operators.paging import numbered
from tagloom.session import materialize

# Names looked at first, per free place in the vocabulary. Only speed depends on
# it: if they leave room, all remaining names follow.
NAMES_PER_PLACE = 4

NEW_TAGS = "tag_id bigint, name string, key string, born_id string, born_idx int"


def first_seen(proposals: DataFrame) -> DataFrame:
    """``key, first``: distinct lower-cased names with their first occurrence.

    ``first`` is ``struct(id, idx, name)`` and so keeps the first spelling. The
    minimum is combined map-side, so a name in a third of all rows is no burden.
    """
    seen = F.struct("id", F.col("idx").cast("int").alias("idx"), "name")
    return proposals.groupBy(F.lower("name").alias("key")).agg(
        F.min(seen).alias("first")
    )


def _similar(theta: float, *names: DataFrame) -> bool:
    """Whether names of these lengths can be similar without being equal."""
    keys = (df.select(F.col("key").alias("name")) for df in names)
    return allowed_edits(longest_name(*keys), theta) > 0


def _unlike(names, known, theta):
    """Names that resemble none of the known keys."""
    left = names.select(F.col("key").alias("name"))
    right = known.select(F.col("key").alias("name"))
    taken = fuzzy_pairs(left, right, theta).select(
        F.col("left_name").alias("key")
    )
    return names.join(taken.distinct(), "key", "left_anti")


def _leaders(names, theta):
    """First-come leaders among materialized ``key, first`` rows."""
    keys = names.select(F.col("key").alias("name"))
    pairs = fuzzy_pairs(keys, keys, theta, once=True)
    left = names.select(F.col("key").alias("left_name"), F.col("first").alias("a"))
    right = names.select(F.col("key").alias("right_name"), F.col("first").alias("b"))
    ordered = pairs.join(left, "left_name").join(right, "right_name")
    left_first = F.col("a") < F.col("b")
    edges = ordered.select(
        F.when(left_first, F.col("left_name")).otherwise(F.col("right_name")).alias("earlier"),
        F.when(left_first, F.col("right_name")).otherwise(F.col("left_name")).alias("later"),
    )
    lost = followers(edges).withColumnRenamed("item", "key")
    return names.join(lost, "key", "left_anti")


def allocate_ids(new: DataFrame, high_water: int, order: str = "first") -> DataFrame:
    """Adds ``tag_id`` behind the largest id ever used, in ``order``."""
    placed = numbered(new, order, "place_no")
    return placed.withColumn("tag_id", F.col("place_no") + F.lit(high_water)).drop("place_no")


def grow_vocabulary(
    proposals: DataFrame,
    vocabulary: DataFrame,
    theta: float = SIMILARITY_THRESHOLD,
    max_tags: int = MAX_TAGS,
    high_water: int | None = None,
) -> DataFrame:
    """New tags: ``tag_id, name, key, born_id, born_idx``.

    ``proposals`` is ``id, idx, name``; ``vocabulary`` is ``id, name``. Ids
    continue behind ``high_water``, by default the largest existing id. Both
    inputs are read more than once and should be stored or materialized.
    """
    n_known, top_id = vocabulary.agg(
        F.count("*"), F.coalesce(F.max("id"), F.lit(0))
    ).first()
    known = vocabulary.select(F.lower("name").alias("key")).distinct()
    room = max(0, max_tags - n_known)
    mark = top_id if high_water is None else high_water
    if not room:
        return proposals.sparkSession.createDataFrame([], NEW_TAGS)
    fresh = materialize(first_seen(proposals).join(known, "key", "left_anti"), "fresh")
    if _similar(theta, fresh, known):
        fresh = materialize(_unlike(fresh, known, theta), "unlike")
        head_size = NAMES_PER_PLACE * room
        if fresh.count() > head_size:
            chosen = _with_head(fresh, head_size, room, theta)
        else:
            chosen = _leaders(fresh, theta)
    else:
        chosen = fresh
    grown = allocate_ids(chosen, mark).where(F.col("tag_id") <= mark + room).select(
        "tag_id",
        F.col("first.name").alias("name"),
        "key",
        F.col("first.id").alias("born_id"),
        F.col("first.idx").alias("born_idx"),
    )
    return materialize(grown, "new-tags")


def _with_head(fresh, head_size, room, theta):
    """Leaders found in the first names alone, and in the rest only if needed.

    Whether a name leads depends on earlier names only, so once the first names
    fill the room the rest cannot add anything.
    """
    placed = numbered(fresh, "first", "place_no")
    head = materialize(placed.where(F.col("place_no") <= head_size).drop("place_no"), "head")
    leaders = materialize(_leaders(head, theta), "leaders")
    if leaders.count() >= room:
        return leaders
    rest = placed.where(F.col("place_no") > head_size).drop("place_no")
    rest = materialize(_unlike(rest, leaders, theta), "rest")
    return leaders.unionByName(_leaders(rest, theta))


def assign_tags(
    proposals: DataFrame,
    vocabulary: DataFrame,
    new_tags: DataFrame | None = None,
    theta: float = SIMILARITY_THRESHOLD,
) -> DataFrame:
    """``id, idx, name, tag_id, similarity, is_new`` per matched proposal.

    Each occurrence gets the best of the tags that exist at that point: all of
    ``vocabulary`` and those of ``new_tags`` born there or earlier. Ties go to
    the lowest id. ``is_new`` marks the occurrence that created its tag. A name
    that equals a tag always gets it, since a tag is born where its name first
    occurs; similarity is only worked out for the other names. Of tags that differ
    in case only, the lowest id stands for all.
    """
    tags = vocabulary.groupBy(F.lower("name").alias("key")).agg(
        F.min("id").alias("tag_id")
    ).select("tag_id", "key", F.lit(None).cast("struct<id: string, idx: int>").alias("born"))
    if new_tags is not None:
        born = F.struct(
            F.col("born_id").alias("id"), F.col("born_idx").cast("int").alias("idx")
        )
        tags = tags.unionByName(
            new_tags.select("tag_id", "key", born.alias("born"))
        )
    equal = tags.select(
        "key", F.array(F.struct(F.lit(-1.0).alias("rank"), "tag_id", "born")).alias("options")
    )
    options = equal
    names = proposals.select(F.lower("name").alias("key")).distinct()
    open_names = materialize(names.join(tags.select("key"), "key", "left_anti"), "open-names")
    if _similar(theta, open_names, tags):
        pairs = fuzzy_pairs(
            open_names.select(F.col("key").alias("name")),
            tags.select(F.col("key").alias("name")),
            theta,
        )
        scored = pairs.join(tags, pairs["right_name"] == tags["key"]).select(
            F.col("left_name").alias("key"),
            (-F.col("similarity")).alias("rank"), "tag_id", "born",
        )
        # at most one entry per tag, so the list is as short as the vocabulary
        fuzzy = scored.groupBy("key").agg(
            F.sort_array(F.collect_list(F.struct("rank", "tag_id", "born"))).alias("options")
        )
        options = materialize(equal.unionByName(fuzzy), "options")
    here = F.struct(F.col("id"), F.col("idx").cast("int").alias("idx"))
    usable = F.filter("options", lambda o: o["born"].isNull() | (o["born"] <= here))
    best = F.get(usable, F.lit(0))
    return (
        proposals.withColumn("key", F.lower("name")).join(options, "key")
        .withColumn("best", best)
        .where(F.col("best").isNotNull())
        .select(
            "id", "idx", "name",
            F.col("best.tag_id").alias("tag_id"),
            (-F.col("best.rank")).alias("similarity"),
            F.coalesce(F.col("best.born") == here, F.lit(False)).alias("is_new"),
        )
    )
