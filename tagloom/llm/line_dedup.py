"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending ids. The hashes of all lines seen so far
lie in sorted runs, each a table bucketed and sorted by hash. A new batch reduces
its lines to one row per hash and merges with every run; what no run holds becomes
a new run. As soon as a level has ``fanout`` runs they are compacted into one run
of the next level, so a hash is rewritten once per level and a batch meets few
runs. Since runs and batches share their bucketing, merging doesn't shuffle the
runs.

Only hashes (16 bytes a line) travel; lines themselves stay with their documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import BLANKS, ascii_lower, long_hash, whole, write_bucketed
from tagloom.session import materialize, scratch_path

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _counts(key: Column) -> Column:
    return F.length(key) >= MIN_CHARS


class LineRuns:
    """Runs of line hashes in ``folder``, by level; lives as long as the session."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        return write_bucketed(rows, HASH, self.folder, f"line_run_{level}")

    def _run(self, table: str) -> DataFrame:
        return self.spark.table(table).where(~F.col("seen")).select(*HASH)

    def add(self, keys: DataFrame) -> DataFrame:
        """Takes in a batch of ``h1, h2, doc_id``; ids above all earlier ones.

        Returns ``h1, h2, owner`` of hashes that occur in at least two documents
        so far: ``owner`` keeps its lines, null if an earlier batch owns them.
        """
        marked = keys.groupBy(*HASH).agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
        )
        seen: list[Column] = []
        for i, table in enumerate(t for level in self.levels for t in level):
            run = self._run(table).withColumn(f"in{i}", F.lit(True))
            marked = marked.join(run.hint("merge"), HASH, "left")
            seen.append(F.col(f"in{i}").isNotNull())
        known = reduce(lambda a, b: a | b, seen, F.lit(False))
        table = self._write(marked.select(*HASH, "first", "last", known.alias("seen")), 0)
        self._place(table, 0)
        # read by path: both sides of a join with lines can then be split if skewed
        schema = "h1 bigint, h2 bigint, first bigint, last bigint, seen boolean"
        fresh = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        return fresh.where(F.col("seen") | (F.col("first") != F.col("last"))).select(
            *HASH, F.when(~F.col("seen"), F.col("first")).alias("owner")
        )

    def _place(self, table: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = reduce(DataFrame.unionByName, map(self._run, runs))
            self._place(
                self._write(merged.withColumn("seen", F.lit(False)), level + 1), level + 1
            )

    def forget(self) -> None:
        """Takes the runs out of the session's catalog; their files stay."""
        for table in (t for level in self.levels for t in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _hashed_lines(docs: DataFrame, cuts: list[int]) -> DataFrame:
    keys = F.filter(F.transform(F.split("text", "\n"), line_key), _counts)
    hashed = F.array_distinct(F.transform(
        keys, lambda k: F.struct(long_hash(k).alias("h1"), long_hash(F.lit(7), k).alias("h2"))
    ))
    batch = reduce(
        lambda a, cut: a + (F.col("doc_id") > cut).cast("int"), cuts, F.lit(0)
    ).alias("batch")
    return docs.select("doc_id", batch, F.explode(hashed).alias("h")).select(
        "doc_id", "h.h1", "h.h2", "batch"
    )


def repeated_lines(
    docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``doc_id, drops``: hashes of the lines that each document loses.

    ``docs`` holds ``doc_id`` (integers) and ``text`` without nulls.
    """
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else []
    cuts = sorted(set(found or []))
    path = scratch_path(spark, "line-hashes")
    _hashed_lines(docs, cuts).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id bigint, h1 bigint, h2 bigint, batch int").parquet(path)
    runs = LineRuns(spark, scratch_path(spark, "line-runs"), fanout)
    dropped = []
    for batch in range(len(cuts) + 1):
        own = lines.where(F.col("batch") == batch).drop("batch")
        twice = runs.add(own)
        dropped.append(
            own.join(twice, HASH)
            .where(F.col("owner").isNull() | (F.col("owner") != F.col("doc_id")))
            .select("doc_id", "h1")
        )
    drops = materialize(
        reduce(DataFrame.unionByName, dropped).groupBy("doc_id")
        .agg(F.collect_set("h1").alias("drops")),
        "line-drops",
    )
    runs.forget()
    return drops


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    batches: int = BATCHES,
    fanout: int = FANOUT,
    carry: str | None = None,
) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the kept ``text`` of every row.

    A key of at least ten characters that stands in two documents or more keeps
    its lines only in the one of the smallest id. A null or empty text is one
    empty line. Rows of one id are one document; rows without an id lose nothing.
    Other columns are not read, unless ``carry`` names a column that holds the
    input row without its text. An empty table gives an empty result.
    """
    rest = [] if carry is None else [
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias(carry)
    ]
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), whole(text).alias("text"), *rest
    )
    rest = [] if carry is None else [carry]
    drops = repeated_lines(own.where(F.col("doc_id").isNotNull()), batches, fanout)
    lines = F.split("text", "\n")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~(_counts(key) & F.array_contains(F.col("drops"), long_hash(key)))

    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, stays))
    return (
        own.join(drops.hint("shuffle_hash"), "doc_id", "left")
        .select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), kept.alias("kept"), *rest)
        .select(
            "doc_id", "n_lines",
            (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"), *rest,
        )
    )
