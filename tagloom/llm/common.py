"""Column helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def blank_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Runs of digits, a-z and everything beyond ASCII; the text is lower-case."""
    return F.filter(
        F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""
    )


def long_hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def sha256_hex(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def quoted(words) -> str:
    """SQL string literals, comma separated."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def write_bucketed(df: DataFrame, keys: list[str], path: str, name: str) -> str:
    """Writes ``df`` below ``path`` as a table bucketed and sorted by ``keys``.

    Returns the table's name in the session's catalog. Joins on the keys don't
    shuffle such a table; the folder ``path/<name>`` can also be read as plain files.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"{name}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys)
        .write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
        .option("path", f"{path}/{table_name}").saveAsTable(table_name)
    )
    return table_name


def travels_with_tasks(module: str) -> None:
    """Functions of the module go to Python workers by value.

    So executors need the libraries it imports, but not this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the worker process, whatever task asks.

    One at a time: asking for another drops it, so that operators that follow each
    other in a process don't add up.
    """
    keeper = sys.modules.setdefault("_tagloom_worker", ModuleType("_tagloom_worker"))
    if vars(keeper).get("current") != name:
        keeper.current, keeper.held = name, {}
    return keeper.held


def release_worker() -> None:
    """Gives up what the worker process has kept, back to the machine."""
    keeper = sys.modules.get("_tagloom_worker")
    if keeper is not None:
        keeper.current, keeper.held = None, {}
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def then_release(work):
    """A function over a partition's batches that leaves nothing in the worker."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release_worker()

    return run


travels_with_tasks(__name__)
