"""The three stored tables, published together under one manifest.

A table is laid out in buckets by a hash of its key. A publish writes the buckets that
change into a new folder and then one manifest row set that names the current folder of
every bucket of every table, and the merge forest. Readers only follow the newest
manifest, so they see all tables of one publish or none of them, and a folder that is
being read is never overwritten. One writer at a time is assumed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.schemas import TABLES

MANIFEST_SCHEMA = (
    "table_name string, folders array<struct<folder: string, buckets: array<int>>>, "
    "n_buckets int, high_water bigint, folded map<string, bigint>, cleared bigint, "
    "merges string"
)
MERGE_SCHEMA = "merge_id bigint, primary_id bigint"

KEYS = {"snippets": "id", "tags": "id", "snippet_tags": "snippet_id"}
ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4_096


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Layout:
    """Where the buckets of a table are: by folder, the buckets that count there."""

    buckets: int
    folders: Mapping[str, tuple[int, ...]]

    def paths(self, base: str, wanted: set[int] | None = None) -> list[str]:
        return [
            f"{base}/{folder}/bucket={b}"
            for folder, own in self.folders.items()
            for b in own if wanted is None or b in wanted
        ]

    def without(self, gone: set[int]) -> Layout:
        rest = {f: tuple(b for b in own if b not in gone) for f, own in self.folders.items()}
        return Layout(self.buckets, {f: own for f, own in rest.items() if own})

    def with_folder(self, folder: str, own: list[int]) -> Layout:
        return Layout(self.buckets, {**self.folders, folder: tuple(own)} if own else self.folders)


@dataclass(frozen=True)
class Snapshot:
    """All tables as of one publish.

    ``high_water`` is the largest tag id ever given out; it survives deletes and
    clears. ``folded`` is the newest batch of each stream sink that is included,
    ``cleared`` the version of the last clear.
    """

    spark: SparkSession
    base: str
    version: int = 0
    layouts: Mapping[str, Layout] = field(default_factory=dict)
    high_water: int = 0
    folded: Mapping[str, int] = field(default_factory=dict)
    cleared: int = 0
    merge_folder: str | None = None

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or only some of its buckets."""
        if table not in self.layouts:
            raise LookupError(f"table {table} is not initialised below {self.base}")
        paths = self.layouts[table].paths(self.base, buckets)
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    def touched(self, table: str, keys: DataFrame) -> set[int]:
        """Buckets of the keys (one column); at most ``MAX_BUCKETS`` small numbers."""
        spot = bucket_of(F.col(keys.columns[0]), self.layouts[table].buckets)
        return {row[0] for row in keys.select(spot).distinct().collect()}

    @property
    def merges(self) -> DataFrame:
        """``merge_id, primary_id``: the tag that each merged tag stands for now."""
        if self.merge_folder is None:
            return self.spark.createDataFrame([], MERGE_SCHEMA)
        return self.spark.read.schema(MERGE_SCHEMA).parquet(f"{self.base}/{self.merge_folder}")

    @property
    def snippets(self) -> DataFrame:
        return self.read("snippets")

    @property
    def tags(self) -> DataFrame:
        return self.read("tags")

    @property
    def snippet_tags(self) -> DataFrame:
        return self.read("snippet_tags")


class TableStore:
    """Snippets, tags and their junction below one base folder.

    A table that is written whole gets a bucket per ``rows_per_bucket`` rows, so that a
    few changed rows rewrite few of them however large the table is.
    """

    def __init__(self, spark: SparkSession, base: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark = spark
        self.base = base.rstrip("/")
        self.rows_per_bucket = rows_per_bucket

    def snapshot(self) -> Snapshot:
        """The newest publish; every manifest has one row per table."""
        schema = MANIFEST_SCHEMA + ", version bigint"
        try:
            log = self.spark.read.schema(schema).json(f"{self.base}/_manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return Snapshot(self.spark, self.base)
        rows = log.orderBy(F.desc("version")).limit(len(TABLES)).collect()
        if not rows:
            return Snapshot(self.spark, self.base)
        return Snapshot(
            self.spark,
            self.base,
            rows[0]["version"],
            {
                row["table_name"]: Layout(
                    row["n_buckets"], {f["folder"]: tuple(f["buckets"]) for f in row["folders"]}
                )
                for row in rows
            },
            rows[0]["high_water"],
            dict(rows[0]["folded"] or {}),
            rows[0]["cleared"] or 0,
            rows[0]["merges"],
        )

    def read_snippets(self) -> DataFrame:
        return self.snapshot().snippets

    def read_tags(self) -> DataFrame:
        return self.snapshot().tags

    def read_snippet_tags(self) -> DataFrame:
        return self.snapshot().snippet_tags

    def init_tables(self) -> Snapshot:
        """Create empty tables where there are none; otherwise change nothing."""
        current = self.snapshot()
        return current if current.version else self.publish({})

    def _buckets_for(self, old: Snapshot, name: str, frame: DataFrame) -> int:
        """For a table written whole, by its rows so far (which the footers tell)."""
        known = old.layouts[name].folders if name in old.layouts else None
        rows = (old.read(name) if known else frame).count()
        return min(MAX_BUCKETS, max(1, -(-rows // self.rows_per_bucket)))

    def publish(
        self,
        frames: Mapping[str, DataFrame],
        high_water: int | None = None,
        folded: Mapping[str, int] | None = None,
        clear: bool = False,
        touched: Mapping[str, set[int]] | None = None,
        merges: DataFrame | None = None,
    ) -> Snapshot:
        """Write new versions of the given tables and switch to them at once.

        A frame of a table in ``touched`` holds those buckets' new rows; all other
        buckets stay as they are. Other frames replace the whole table. Tables that were
        never written start out empty. Without tables only the marks move, which is how
        a stream reserves the ids it gives out. ``clear`` notes that results found
        before this version are void. ``merges`` replaces the merge forest.
        """
        unknown = set(frames) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        old = self.snapshot()
        version = old.version + 1
        layouts = dict(old.layouts)
        for name, schema in TABLES.items():
            frame = frames.get(name)
            if frame is None and name in layouts:
                continue
            folder = f"{name}/{version:08d}-{uuid.uuid4().hex}"
            if frame is None:
                layouts[name] = Layout(1, {})
                continue
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
            frame = frame.select(*columns)
            written = None if touched is None else touched.get(name)
            if written is not None and not written:
                continue
            if written is None or len(written) == layouts[name].buckets:
                rest = Layout(self._buckets_for(old, name, frame), {})
            else:
                rest = layouts[name].without(written)
            own = self._write(frame, name, rest.buckets, folder)
            layouts[name] = rest.with_folder(folder, own)
        merge_folder = old.merge_folder
        if merges is not None:
            merge_folder = f"merges/{version:08d}-{uuid.uuid4().hex}"
            merges.select("merge_id", "primary_id").write.parquet(f"{self.base}/{merge_folder}")
        mark = max(old.high_water, high_water or 0)
        batches = {**old.folded, **(folded or {})}
        cleared = version if clear else old.cleared
        entries = [
            (name, [(f, list(b)) for f, b in layouts[name].folders.items()],
             layouts[name].buckets, mark, batches, cleared, merge_folder)
            for name in TABLES
        ]
        (
            self.spark.createDataFrame(entries, MANIFEST_SCHEMA)
            .coalesce(1)
            .write.json(f"{self.base}/_manifest/version={version}")
        )
        return Snapshot(
            self.spark, self.base, version, layouts, mark, batches, cleared, merge_folder
        )

    def _write(self, frame: DataFrame, name: str, buckets: int, folder: str) -> list[int]:
        """Rows below ``folder`` in a folder per bucket; the buckets that have any."""
        path = f"{self.base}/{folder}"
        if buckets == 1:
            frame.write.parquet(f"{path}/bucket=0")
            return [0]
        (
            frame.withColumn("bucket", bucket_of(F.col(KEYS[name]), buckets))
            .repartition(buckets, "bucket").sortWithinPartitions("bucket", KEYS[name])
            .write.partitionBy("bucket").parquet(path)
        )
        files = self.spark.read.schema(TABLES[name]).parquet(path).inputFiles()
        return sorted({int(re.search(r"/bucket=(\d+)/", file)[1]) for file in files})
