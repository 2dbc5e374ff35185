"""Exact and fuzzy matching of proposed names to tags, without a cross product.

Two names within ``k`` edits share a text that both reach by removing at most
``k`` characters. Names therefore meet in an equi-join on hashes of such shorter
texts, and the join condition itself checks the similarity, so unverified pairs
are never written anywhere. The number of keys depends on the name's length
alone; a key only gathers names that are all but equal, however skewed the
occurrences are, because distinct names are compared and never occurrences.

For long names, where removing four or more characters would make too many
texts, the longer name is cut into ``k + 1`` pieces; at least one piece is found
unchanged in the shorter name, shifted by at most ``k``. Both ways are exact and
together they cover every length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import SIMILARITY_THRESHOLD
from tagloom.functions.similarity import (
    allowed_edits,
    first_length_with_edits,
    shorter_by_one,
    similarity,
)

MOST_REMOVALS = 3


def exact_match(proposals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Proposals whose lower-cased name is a tag: adds ``tag_id``.

    Of tags that differ in case only, the lowest id stands for all.
    """
    tags = vocabulary.groupBy(F.lower("name").alias("_key")).agg(F.min("id").alias("tag_id"))
    return proposals.join(tags, F.lower(proposals["name"]) == F.col("_key")).drop("_key")


def removal_keys(names: DataFrame, theta: float) -> DataFrame:
    """``name, key``: hashes of the name with up to its allowed removals."""
    size = F.length("name")
    none = F.array().cast("array<string>")
    step = names.select("name", F.array("name").alias("k0"))
    levels = ["k0"]
    for removed in range(1, MOST_REMOVALS + 1):
        enough = size >= first_length_with_edits(removed, theta)
        shorter = F.when(enough, shorter_by_one(levels[-1])).otherwise(none)
        step = step.withColumn(f"k{removed}", shorter)
        levels.append(f"k{removed}")
    texts = F.array_distinct(F.concat(*levels))
    return step.select("name", F.explode(texts).alias("text")).select(
        "name", F.xxhash64("text").alias("key")
    )


def _piece_bounds(length: Column, pieces: Column, index: Column) -> tuple[Column, Column]:
    """1-based start and size of one of ``pieces`` nearly equal pieces."""
    start = F.floor(index * length / pieces)
    stop = F.floor((index + 1) * length / pieces)
    return (start + 1).cast("int"), (stop - start).cast("int")


def _edits(length: Column, theta: float) -> Column:
    return F.floor(F.lit(1.0 - theta) * length + F.lit(1e-9)).cast("int")


def _pieces(names: DataFrame, theta: float, shortest: int) -> DataFrame:
    """``name, key`` for names in the role of the longer one."""
    size = F.length("name")
    long = names.where(size >= shortest)
    parts = _edits(size, theta) + 1
    indexed = long.select(
        "name", parts.alias("parts"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"),
    )
    start, width = _piece_bounds(F.length("name"), F.col("parts"), F.col("i"))
    piece = F.substring(F.col("name"), start, width)
    return indexed.select(
        "name", F.xxhash64(F.length("name"), "i", piece).alias("key")
    )


def _windows(names: DataFrame, theta: float, shortest: int) -> DataFrame:
    """``name, key`` for names in the role of the shorter one.

    One row per possible longer length, piece of it and shift.
    """
    size = F.length("name")
    # a longer name of length b differs by b - size <= (1 - theta) * b edits
    reach = F.floor(size / F.lit(theta) + F.lit(1e-6)).cast("int")
    top = F.greatest(reach, size)
    lengths = names.where(top >= shortest).select(
        "name",
        F.explode(F.sequence(F.greatest(size, F.lit(shortest)), top)).alias("b"),
    )
    k = _edits(F.col("b"), theta)
    fitting = lengths.withColumn("k", k).where(F.col("b") - F.length("name") <= F.col("k"))
    placed = fitting.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    shifted = placed.withColumn("s", F.explode(F.sequence(-F.col("k"), F.col("k"))))
    start, width = _piece_bounds(F.col("b"), F.col("k") + 1, F.col("i"))
    first = start + F.col("s")
    inside = (first >= 1) & (first + width - 1 <= F.length("name"))
    piece = F.substring(F.col("name"), first, width)
    return (
        shifted.where(inside)
        .select("name", F.xxhash64("b", "i", piece).alias("key"))
        .distinct()
    )


def _meet(left: DataFrame, right: DataFrame, theta: float, once: bool) -> DataFrame:
    """Verified pairs of two key tables; ``once`` keeps name order only.

    Spark takes a key table for as small as the names it comes from and would build
    the whole of it in the driver to broadcast it; so the two are merged.
    """
    l = left.select(F.col("name").alias("left_name"), "key")
    r = right.select(F.col("name").alias("right_name"), F.col("key").alias("_key"))
    alike = similarity(F.col("left_name"), F.col("right_name"))
    met = (F.col("key") == F.col("_key")) & (alike >= theta)
    if once:
        met = met & (F.col("left_name") < F.col("right_name"))
    return l.join(r.hint("merge"), met).select("left_name", "right_name")


def longest_name(*names: DataFrame) -> int:
    """Length of the longest ``name`` of all inputs, 0 if there is none."""
    sizes = [df.select(F.length("name").alias("size")) for df in names]
    found = reduce(DataFrame.unionByName, sizes).agg(F.max("size")).first()[0]
    return found or 0


def fuzzy_pairs(
    left: DataFrame,
    right: DataFrame,
    theta: float = SIMILARITY_THRESHOLD,
    once: bool = False,
) -> DataFrame:
    """All pairs of distinct names with similarity of at least ``theta``.

    Both inputs have a column ``name``; compare lower-cased names. They are read
    more than once and should be stored or materialized. The longest name there is
    decides which of the plans are needed. With ``once`` the inputs are the same
    names and every pair comes once.
    """
    longest = longest_name(left, right)
    long_from = first_length_with_edits(MOST_REMOVALS + 1, theta)
    l, r = left.select("name"), right.select("name")
    if allowed_edits(longest, theta) == 0:
        keyed = [F.xxhash64("name").alias("key")]
        found = _meet(l.select("name", *keyed), r.select("name", *keyed), theta, once)
    else:
        short = F.length("name") < long_from
        found = _meet(
            removal_keys(l.where(short), theta), removal_keys(r.where(short), theta),
            theta, once,
        )
        if longest >= long_from:
            longer_left = _meet(
                _pieces(l, theta, long_from), _windows(r, theta, long_from), theta, False
            )
            longer_right = _meet(
                _windows(l, theta, long_from), _pieces(r, theta, long_from), theta, False
            )
            long_pairs = longer_left.unionByName(longer_right)
            if once:
                long_pairs = long_pairs.where(F.col("left_name") < F.col("right_name"))
            found = found.unionByName(long_pairs)
    alike = similarity(F.col("left_name"), F.col("right_name"))
    return found.distinct().withColumn("similarity", alike)


def best_match(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per left name the most similar tag; ties go to the lowest id.

    ``vocabulary`` gives the ids of the right names. A maximum is combined
    map-side, so popular names do not gather their candidates in one task.
    """
    ids = vocabulary.select(F.lower("name").alias("right_name"), F.col("id").alias("tag_id"))
    ranked = pairs.join(ids, "right_name")
    best = F.max_by(F.struct("tag_id", "similarity"), F.struct("similarity", -F.col("tag_id")))
    return (
        ranked.groupBy("left_name").agg(best.alias("b"))
        .select("left_name", "b.tag_id", "b.similarity")
    )
