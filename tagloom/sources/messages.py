"""Queue messages as files or Kafka records, and the dead-letter sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.config import MESSAGE_PRIORITY
from tagloom.functions.errors import DEAD
from tagloom.sources.schemas import MESSAGES


# Messages in a file, so that a number of files bounds a micro-batch.
ROWS_PER_FILE = 50_000


def read_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files: int | None = None,
    archive: str | None = None,
    **options: str,
) -> DataFrame:
    """A stream of messages from a folder of Parquet or JSON files.

    ``max_files`` bounds the files of a micro-batch. With ``archive`` files move there
    once their batch is through, so the folder only holds what is still to do.
    """
    if max_files is not None:
        options["maxFilesPerTrigger"] = str(max_files)
    if archive is not None:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    return (
        spark.readStream.format(fmt).schema(MESSAGES).options(**options).load(path)
    )


def delivery_key() -> list[Column]:
    """Names one delivery: ``snippet_id, run, attempts``."""
    return [
        F.col("snippet_id"), F.coalesce("run", "timestamp").alias("run"),
        F.coalesce("attempts", F.lit(1)).alias("attempts"),
    ]


def read_kafka_messages(spark: SparkSession, **options: str) -> DataFrame:
    """A stream of JSON messages from Kafka (needs the Kafka package)."""
    raw = spark.readStream.format("kafka").options(**options).load()
    body = F.from_json(F.col("value").cast("string"), MESSAGES)
    return raw.select(body.alias("m")).select("m.*")


def as_messages(backlog: DataFrame, queued_at_ms: int | Column) -> DataFrame:
    """One first-delivery message per snippet id."""
    stamp = queued_at_ms if isinstance(queued_at_ms, Column) else F.lit(queued_at_ms)
    return backlog.select(
        F.col("id").alias("snippet_id"),
        stamp.cast("bigint").alias("timestamp"),
        F.lit(MESSAGE_PRIORITY).alias("priority"),
        F.lit(1).alias("attempts"),
        stamp.cast("bigint").alias("run"),
    )


def enqueue(
    backlog: DataFrame,
    path: str,
    queued_at_ms: int,
    fmt: str = "parquet",
    rows_per_file: int = ROWS_PER_FILE,
    **options: str,
) -> None:
    """Append one message per id to a file queue, or send them to Kafka.

    A snippet of two calls has two rounds, told apart by ``queued_at_ms``.
    """
    messages = as_messages(backlog, queued_at_ms)
    if fmt == "kafka":
        packed = messages.select(
            F.col("snippet_id").alias("key"),
            F.to_json(F.struct("*")).alias("value"),
        )
        packed.write.format("kafka").options(**options).save()
    else:
        options.setdefault("maxRecordsPerFile", str(rows_per_file))
        messages.write.format(fmt).options(**options).mode("append").save(path)


def dead_letters(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("action") == DEAD)
