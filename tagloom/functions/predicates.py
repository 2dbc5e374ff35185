"""Row predicates over the JSON ``tags`` column and the text key ``id``.

The column has three states: NULL (never tried), ``[]`` (tried, nothing found)
and a non-empty JSON array. Staying on the JSON text keeps these filters
pushable to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_untagged(tags: Column) -> Column:
    return tags.isNull() | (tags == "[]")


def is_tagged(tags: Column) -> Column:
    return tags.isNotNull() & (tags != "[]")


def snippet_by_id(snippets: DataFrame, snippet_id: str) -> DataFrame:
    return snippets.where(F.col("id") == F.lit(snippet_id))


def after(df: DataFrame, cursor: str | None) -> DataFrame:
    """Rows behind a keyset cursor; all rows without one."""
    return df if cursor is None else df.where(F.col("id") > F.lit(cursor))
