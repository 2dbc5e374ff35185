"""Snippet text by key, and the ids for which something is missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT_BUCKETS = 1024


def read_content_files(spark: SparkSession, folder: str) -> DataFrame:
    """One UTF-8 object per snippet; the file name is the snippet id."""
    return (
        spark.read.format("binaryFile").load(folder)
        .select(
            F.col("_metadata.file_name").alias("id"),
            F.decode("content", "UTF-8").alias("text"),
        )
    )


@dataclass(frozen=True)
class KeyedContent:
    """Content laid out in folders by a hash of the id.

    A page or micro-batch then reads the folders of its own ids and not the
    whole store.
    """

    table: DataFrame
    buckets: int

    def of(self, ids: DataFrame) -> DataFrame:
        needed = [
            row["bucket"]
            for row in ids.select(bucket(F.col("id"), self.buckets)).distinct().collect()
        ]  # at most ``buckets`` small numbers
        table = self.table
        if len(needed) < self.buckets:
            table = table.where(F.col("bucket").isin(needed))
        return table.select("id", "text")


Content = DataFrame | KeyedContent


def bucket(snippet_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(snippet_id), F.lit(buckets)).cast("int").alias("bucket")


def write_content(
    content: DataFrame, path: str, buckets: int = CONTENT_BUCKETS, files_per_bucket: int = 1
) -> None:
    """Lay content out for ``KeyedContent``; more files per bucket for more data."""
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(files_per_bucket))
    (
        content.select("id", "text", bucket(F.col("id"), buckets))
        .repartition("bucket", share)
        .sortWithinPartitions("bucket", "id")
        .write.partitionBy("bucket").parquet(path)
    )


def read_keyed_content(
    spark: SparkSession, path: str, buckets: int = CONTENT_BUCKETS
) -> KeyedContent:
    schema = "id string, text string, bucket int"
    return KeyedContent(spark.read.schema(schema).parquet(path), buckets)


def content_of(content: Content, ids: DataFrame) -> DataFrame:
    """``id, text`` in which the texts of ``ids`` can be found."""
    if isinstance(content, KeyedContent):
        return content.of(ids)
    return content.select("id", "text")


def with_content(snippets: DataFrame, content: DataFrame) -> DataFrame:
    return snippets.join(content.select("id", "text"), "id")


def snippet_error(snippet_id: Column, message: Column) -> Column:
    """How a run reports the error of one snippet."""
    return F.concat(F.lit("Snippet "), snippet_id, F.lit(": "), message)


def missing_content(
    ids: DataFrame, snippets: DataFrame, content: DataFrame
) -> DataFrame:
    """Ids without metadata or without text: ``id, message, error``.

    Each big table is first cut down to the ids asked for. With few ids they are
    broadcast and neither table is shuffled; with many, everything is exchanged
    by id once and the second step finds it in place.
    """
    asked = ids.select("id").distinct()
    known = snippets.select("id").join(asked, "id", "left_semi")
    texts = content.select("id").join(asked, "id", "left_semi")
    marked = (
        asked.join(known.withColumn("has_row", F.lit(True)), "id", "left")
        .join(texts.withColumn("has_text", F.lit(True)), "id", "left")
    )
    key = F.col("id")
    message = (
        F.when(
            F.col("has_row").isNull(),
            F.concat(F.lit("Snippet "), key, F.lit(" not found")),
        )
        .when(
            F.col("has_text").isNull(),
            F.concat(
                F.lit("Content for snippet "), key, F.lit(" not found in content store")
            ),
        )
    )
    return (
        marked.select("id", message.alias("message"))
        .where(F.col("message").isNotNull())
        .select("id", "message", snippet_error(key, F.col("message")).alias("error"))
    )
