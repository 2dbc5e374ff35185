"""Merge plans: planner input, validation, overlaps and similarity planners."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.config import DEFAULT_REASON, MERGES_PER_GROUP, SIMILARITY_THRESHOLD, Profile
from tagloom.functions.plan_text import parse_plan
from tagloom.functions.text import clean_tag, valid_tag
from tagloom.operators.leaders import followers
from tagloom.operators.matching import fuzzy_pairs
from tagloom.operators.paging import numbered
from tagloom.session import materialize

BLOCK_ROWS = 512
# Tags whose vectors are all compared with each other in a round, and rows that meet
# the leaders found among them in one group.
HEAD_TAGS = 4096
TILE_ROWS = 8192


def planner_input(tags: DataFrame) -> DataFrame:
    """The whole vocabulary as one text, most used first; NULL when empty.

    The text is what a planner is shown, so it is one value by nature; its size
    is limited by the vocabulary's.
    """
    line = F.concat(
        F.col("id").cast("string"), F.lit(":"), F.col("name"),
        F.lit(" ("), F.col("usage_count").cast("string"), F.lit(")"),
    )
    entry = F.struct((-F.col("usage_count")).alias("rank"), "id", line.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["line"])
    return tags.agg(F.count("*").alias("n_tags"), lines.alias("lines")).select(
        "n_tags",
        F.when(F.col("n_tags") > 0, F.array_join("lines", "\n")).alias("tag_list"),
    )


def plan_groups(replies: DataFrame) -> DataFrame:
    """Groups of planner replies ``reply_no, reply``, as written."""
    return replies.select(
        "reply_no", F.posexplode(parse_plan(F.col("reply"))).alias("pos", "g")
    ).select(
        "reply_no",
        F.col("pos").cast("bigint").alias("group_no"),
        "g.primary_tag_id", "g.primary_tag_name", "g.merge_tag_ids", "g.reason",
    )


def resolve_plan(groups: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per known merge id of a group with a known primary tag."""
    primaries = tags.select(
        F.col("id").alias("primary_id"), F.col("name").alias("primary_name")
    )
    mentions = (
        groups
        .join(primaries, F.col("primary_tag_id") == F.col("primary_id"))
        .select(
            "reply_no", "group_no", "primary_id", "primary_name", "primary_tag_name",
            "reason", F.posexplode("merge_tag_ids").alias("at", "named"),
        )
    )
    known = tags.select(F.col("id").alias("merge_id"))
    return mentions.join(known, F.col("named") == F.col("merge_id")).select(
        "reply_no", "group_no", "primary_id", "primary_name", "primary_tag_name",
        "reason", (F.col("at") + 1).cast("bigint").alias("pos"), "merge_id",
    )


def valid_groups(groups: DataFrame, tags: DataFrame) -> DataFrame:
    """Usable mentions: suggested name only if it is a different one."""
    asked = F.nullif(F.col("primary_tag_name"), F.lit(""))
    suggested = F.when(asked != F.col("primary_name"), asked)
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(DEFAULT_REASON))
    return resolve_plan(groups, tags).select(
        "reply_no", "group_no", "primary_id", "primary_name",
        suggested.alias("suggested_name"), reason.alias("reason"), "pos", "merge_id",
    )


def resolve_overlaps(groups: DataFrame) -> DataFrame:
    """Mentions with ``verdict``: ``merge`` or why a mention is dropped.

    An id belongs to the first group that names it, as primary or to be merged.
    A group whose primary belongs to an earlier group merges nothing.
    """
    where = F.struct("reply_no", "group_no", "pos")
    as_primary = groups.select(
        F.col("primary_id").alias("tag_id"), "reply_no", "group_no",
        F.lit(0).cast("bigint").alias("pos"),
    )
    as_merge = groups.select(F.col("merge_id").alias("tag_id"), "reply_no", "group_no", "pos")
    owner = as_primary.unionByName(as_merge).groupBy("tag_id").agg(
        F.min(where).alias("owner")
    )
    of_merge = owner.select(F.col("tag_id").alias("merge_id"), F.col("owner").alias("merge_owner"))
    of_primary = owner.select(
        F.col("tag_id").alias("primary_id"), F.col("owner").alias("primary_owner")
    )
    home = F.struct("reply_no", "group_no")
    primary_home = F.struct("primary_owner.reply_no", "primary_owner.group_no")
    verdict = (
        F.when(F.col("merge_id") == F.col("primary_id"), "self merge")
        .when((primary_home != home) | (F.col("primary_owner.pos") != 0), "primary taken")
        .when(F.col("merge_owner") != where, "already named")
        .otherwise("merge")
    )
    return (
        groups.join(of_merge, "merge_id").join(of_primary, "primary_id")
        .withColumn("verdict", verdict)
        .select(*groups.columns, "verdict")
    )


def merge_mapping(resolved: DataFrame) -> DataFrame:
    """The mentions that merge; each ``merge_id`` occurs once."""
    return resolved.where(F.col("verdict") == "merge").drop("verdict")


def renames(mapping: DataFrame, tags: DataFrame, profile: Profile) -> DataFrame:
    """Suggested names of merging groups with ``verdict`` ``rename`` or why not.

    A name has to be valid once cleaned and must not belong to any other tag or to
    an earlier rename, since names are unique whatever their case.
    """
    asked = (
        mapping.where(F.col("suggested_name").isNotNull())
        .select("reply_no", "group_no", "primary_id", "primary_name", "suggested_name")
        .distinct()
        .withColumn("new_name", clean_tag(F.col("suggested_name"), profile))
        .withColumn("key", F.lower("new_name"))
    )
    fits = valid_tag(F.col("new_name"), profile) & (
        F.length("new_name") <= profile.max_length
    )
    holders = tags.groupBy(F.lower("name").alias("key")).agg(
        F.collect_set(F.struct("id", "name")).alias("holders")
    )
    own = F.filter("holders", lambda h: h["id"] == F.col("primary_id"))
    others = F.filter("holders", lambda h: h["id"] != F.col("primary_id"))
    first = (
        asked.groupBy("key")
        .agg(F.min(F.struct("reply_no", "group_no")).alias("first_asked"))
    )
    verdict = (
        F.when(~fits, "invalid name")
        .when(F.exists(own, lambda h: h["name"] == F.col("new_name")), "unchanged")
        .when(F.size(others) > 0, "name in use")
        .when(F.col("first_asked") != F.struct("reply_no", "group_no"), "name in use")
        .otherwise("rename")
    )
    return (
        asked.join(holders, "key", "left").join(first, "key")
        .withColumn("verdict", verdict)
        .select(
            "reply_no", "group_no", "primary_id", "primary_name",
            "suggested_name", "new_name", "verdict",
        )
    )


# -- planners that need no model ------------------------------------------------
def edit_pairs(
    tags: DataFrame, phi: float = SIMILARITY_THRESHOLD
) -> DataFrame:
    """``a, b, similarity`` for tags with similar names.

    Tags that differ in case only are pairs too, each with the lowest id.
    """
    keyed = tags.select(F.col("id"), F.lower("name").alias("key"))
    names = keyed.select(F.col("key").alias("name")).distinct()
    pairs = fuzzy_pairs(names, names, phi, once=True)
    lowest = keyed.groupBy("key").agg(F.min("id").alias("a"))
    variants = keyed.join(lowest.hint("merge"), "key").where(F.col("id") != F.col("a")).select(
        "a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")
    )
    left = keyed.select(F.col("id").alias("a"), F.col("key").alias("left_name"))
    right = keyed.select(F.col("id").alias("b"), F.col("key").alias("right_name"))
    return (
        pairs.join(left.hint("merge"), "left_name").join(right.hint("merge"), "right_name")
        .select("a", "b", "similarity")
        .unionByName(variants)
    )


def jaccard_pairs(pairs: DataFrame, phi: float) -> DataFrame:
    """``a, b, similarity`` for tags held by the same snippets.

    Tags meet inside a snippet's own short list and are counted map-side. A tag
    that sits on a third of all snippets adds one count per snippet and is never
    joined with itself.
    """
    held = pairs.groupBy("snippet_id").agg(
        F.sort_array(F.collect_set("tag_id")).alias("held")
    )
    firsts = held.select("held", F.posexplode("held").alias("i", "a"))
    together = (
        firsts.select("a", F.explode(F.expr("slice(held, i + 2, size(held))")).alias("b"))
        .groupBy("a", "b").agg(F.count("*").alias("n_both"))
    )
    sizes = held.select(F.explode("held").alias("tag_id")).groupBy("tag_id").agg(
        F.count("*").alias("n")
    )
    of_a = sizes.select(F.col("tag_id").alias("a"), F.col("n").alias("n_a"))
    of_b = sizes.select(F.col("tag_id").alias("b"), F.col("n").alias("n_b"))
    share = F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return (
        together.join(of_a, "a").join(of_b, "b")
        .select("a", "b", share.alias("similarity"))
        .where(F.col("similarity") >= phi)
    )


def cosine_pairs(vectors: DataFrame, phi: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b, similarity`` for vectors ``id, vector`` with cosine >= ``phi``.

    Vectors are hashed into blocks of about ``block_rows`` and every two blocks
    meet in one group, which multiplies them and returns only similar pairs. No
    group holds more than two blocks. Cosines are rounded to six places before
    they are compared.
    """
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = (
        vectors.select("id", F.col("vector").cast("array<double>").alias("vector"),
                       own.alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
    )

    # nested, so that executors only need numpy and pandas
    def unit(rows: pd.Series) -> np.ndarray:
        stacked = np.stack(rows.to_numpy())
        return stacked / np.linalg.norm(stacked, axis=1, keepdims=True)

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        one, two = frame[frame["own"] == low], frame[frame["own"] == high]
        if one.empty or two.empty:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        cosine = np.round(unit(one["vector"]) @ unit(two["vector"]).T, 6)
        rows, columns = np.nonzero(cosine >= phi)
        left, right = one["id"].to_numpy()[rows], two["id"].to_numpy()[columns]
        kept = left < right if low == high else np.ones(len(left), dtype=bool)
        return pd.DataFrame({
            "a": np.minimum(left, right)[kept],
            "b": np.maximum(left, right)[kept],
            "similarity": cosine[rows, columns][kept],
        })

    return met.groupBy("low", "high").applyInPandas(
        multiply, "a bigint, b bigint, similarity double"
    )


def _nearest(rows: DataFrame, leaders: DataFrame, phi: float) -> DataFrame:
    """``no, leader, similarity``: each row's most similar earlier leader, if one is.

    Both have ``no, vector``. A tile of the rows and all leaders given meet in one
    group; so the leaders are exchanged once per tile, and rows once.
    """
    tiles = max(1, math.ceil(rows.count() / TILE_ROWS))
    tile = F.pmod(F.xxhash64("no"), F.lit(tiles)).cast("int").alias("tile")
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    at_once = BLOCK_ROWS

    # nested, so that executors only need numpy and pandas
    def unit(rows: pd.Series) -> np.ndarray:
        stacked = np.stack(rows.to_numpy())
        return stacked / np.linalg.norm(stacked, axis=1, keepdims=True)

    def closest(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"no": [], "leader": [], "similarity": []})]
        if known.empty:
            return found[0]
        known = known.sort_values("no")  # so that the first of equals is the earliest
        leader, vectors = known["no"].to_numpy(), unit(known["vector"])
        for first in range(0, len(frame), at_once):
            some = frame.iloc[first: first + at_once]
            no = some["no"].to_numpy()
            cosine = np.round(unit(some["vector"]) @ vectors.T, 6)
            cosine[~((cosine >= phi) & (leader < no[:, None]))] = -np.inf
            best = cosine.argmax(axis=1)
            similarity = cosine[np.arange(len(some)), best]
            kept = similarity > -np.inf
            found.append(pd.DataFrame({
                "no": no[kept], "leader": leader[best][kept], "similarity": similarity[kept],
            }))
        return pd.concat(found)

    return (
        rows.select("no", "vector", tile).groupBy("tile")
        .cogroup(leaders.select("no", "vector", every).groupBy("tile"))
        .applyInPandas(closest, "no bigint, leader bigint, similarity double")
    )


def leader_pairs(
    tags: DataFrame, vectors: DataFrame, phi: float, head_tags: int = HEAD_TAGS
) -> DataFrame:
    """``a, b, similarity`` of leaders ``a`` by cosine and the tags ``b`` like them.

    Leaders are those of ``star_groups``; of a round's leaders each tag has the most
    similar one only. In a round the first ``head_tags`` undecided tags are compared
    with each other, and all tags with the leaders among them, which decides most of
    the rest. So the pairs of other tags are never worked out, and the work grows with
    tags times leaders. Tags without a vector have no pair.
    """
    known = vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(
        "id", F.col("vector").cast("array<double>").alias("vector")
    )
    order = F.struct((-F.col("usage_count")).alias("rank"), "id")
    placed = materialize(
        numbered(
            tags.join(known, "id", "left_semi").select("id", order.alias("place")).distinct(),
            "place", "no",
        ).select("id", F.col("no").cast("bigint").alias("no")),
        "tag-places",
    )
    rows = materialize(known.join(placed, "id").select("no", "vector"), "placed-vectors")
    rest, near = rows, []
    while True:
        firsts = rest.select("no").distinct().orderBy("no").limit(head_tags)
        end = firsts.agg(F.max("no")).first()[0]
        if end is None:
            break
        head = materialize(rest.where(F.col("no") <= end), "head")
        alike = cosine_pairs(head.withColumnRenamed("no", "id"), phi)
        lost = followers(alike.select(F.col("a").alias("earlier"), F.col("b").alias("later")))
        leaders = materialize(
            head.join(lost.withColumnRenamed("item", "no"), "no", "left_anti"), "leaders"
        )
        near.append(materialize(_nearest(rows, leaders, phi), "nearest"))
        rest = materialize(
            rest.where(F.col("no") > end).join(near[-1].select("no"), "no", "left_anti"), "rest"
        )
    found = tags.sparkSession.createDataFrame([], "no bigint, leader bigint, similarity double")
    for some in near:
        found = found.unionByName(some)
    of_a = placed.select(F.col("id").alias("a"), F.col("no").alias("leader"))
    of_b = placed.select(F.col("id").alias("b"), "no")
    return found.join(of_a, "leader").join(of_b, "no").select("a", "b", "similarity")


def star_groups(
    tags: DataFrame, pairs: DataFrame, reason: str, limit: int = MERGES_PER_GROUP
) -> DataFrame:
    """Groups around the most used tags, shaped like ``valid_groups``.

    By usage, then id, a tag leads unless it is similar to an earlier leader.
    Every other tag joins its most similar leader; a leader takes at most
    ``limit``, the most similar first, and the rest stay as they are. Joins merge:
    tags are as many as the vocabulary has, too many to broadcast from the driver.
    """
    order = F.struct((-F.col("usage_count")).alias("rank"), "id")
    ranked = tags.select("id", "name", order.alias("place"))
    left = ranked.select(F.col("id").alias("a"), F.col("place").alias("place_a"))
    right = ranked.select(F.col("id").alias("b"), F.col("place").alias("place_b"))
    placed = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    a_leads = F.col("place_a") < F.col("place_b")

    def pick(if_a: str, if_b: str, name: str):
        return F.when(a_leads, F.col(if_a)).otherwise(F.col(if_b)).alias(name)

    edges = materialize(
        placed.select(
            pick("a", "b", "earlier"), pick("b", "a", "later"),
            pick("place_a", "place_b", "earlier_place"),
            pick("place_b", "place_a", "later_place"), "similarity",
        ),
        "similar-tags",
    )
    lost = materialize(followers(edges), "followers")
    of_lost = lost.withColumnRenamed("item", "earlier").hint("merge")
    to_leader = edges.join(of_lost, "earlier", "left_anti")
    closest = F.min_by(
        F.struct("earlier", "earlier_place", "later_place", "similarity"),
        F.struct((-F.col("similarity")).alias("far"), "earlier_place"),
    )
    joined = to_leader.groupBy("later").agg(closest.alias("c")).select("later", "c.*")
    best_first = W.partitionBy("earlier").orderBy(F.desc("similarity"), "later_place")
    taken = joined.withColumn("pos", F.row_number().over(best_first)).where(
        F.col("pos") <= limit
    )
    named = ranked.select(F.col("id").alias("earlier"), F.col("name").alias("primary_name"))
    return taken.join(named.hint("merge"), "earlier").select(
        F.lit(0).cast("bigint").alias("reply_no"),
        F.col("earlier").alias("group_no"),
        F.col("earlier").alias("primary_id"),
        "primary_name",
        F.lit(None).cast("string").alias("suggested_name"),
        F.lit(reason).alias("reason"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("later").alias("merge_id"),
    )


def plan_by_similarity(
    tags: DataFrame,
    how: str,
    phi: float,
    pairs: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Merge groups from name (``edit``), vector (``cosine``) or use (``jaccard``).

    ``pairs`` is the junction table, ``vectors`` has ``id, vector`` per tag.
    """
    if how == "edit":
        return star_groups(tags, edit_pairs(tags, phi), "similar names")
    if how == "cosine":
        return star_groups(tags, leader_pairs(tags, vectors, phi), "similar vectors")
    if how == "jaccard":
        return star_groups(tags, jaccard_pairs(pairs, phi), "used together")
    raise ValueError(f"unknown similarity {how!r}")
