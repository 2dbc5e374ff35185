"""Key and reference rules of the three tables, audited instead of enforced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once and the rows too many."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return groups.agg(
        F.lit(rule).alias("rule"),
        F.count("*").alias("n_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_rows"),
    )


def _orphans(pairs: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """Junction keys without a parent row; counted per key before the join."""
    per_key = pairs.groupBy(key).agg(F.count("*").alias("n"))
    known = parent.select(F.col("id").alias(key)).distinct()
    return per_key.join(known, key, "left_anti").agg(
        F.lit(rule).alias("rule"),
        F.count("*").alias("n_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )


def integrity_report(
    snippets: DataFrame, tags: DataFrame, pairs: DataFrame
) -> DataFrame:
    """``rule, n_keys, n_rows``: offending keys and rows per rule."""
    parts = [
        _repeated(snippets, ["id"], "snippet id unique"),
        _repeated(tags, ["id"], "tag id unique"),
        _repeated(tags, ["name"], "tag name unique"),
        _repeated(pairs, ["snippet_id", "tag_id"], "pair unique"),
        _orphans(pairs, snippets, "snippet_id", "pair has snippet"),
        _orphans(pairs, tags, "tag_id", "pair has tag"),
    ]
    return reduce(DataFrame.unionByName, parts)


def cascade(pairs: DataFrame, snippets: DataFrame, tags: DataFrame) -> DataFrame:
    """Pairs that remain once pairs of deleted snippets and tags are gone."""
    return pairs.join(
        snippets.select(F.col("id").alias("snippet_id")), "snippet_id", "left_semi"
    ).join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
