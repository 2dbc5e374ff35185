"""First-come leaders of a similarity graph.

Taken one after the other in a fixed order, an item becomes a leader unless an
earlier leader is its neighbour. The same set comes out of parallel rounds: in
each, every item without an undecided earlier neighbour leads, and its later
neighbours follow. A round is a few joins over the edges that are still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize, scratch_path


def _with_heads(edges: DataFrame) -> DataFrame:
    """Edges with ``leads``: whether nothing undecided comes before ``earlier``."""
    waiting = edges.select(F.col("later").alias("earlier"), F.lit(True).alias("waits"))
    return edges.join(waiting.distinct().hint("merge"), "earlier", "left").select(
        "earlier", "later", F.col("waits").isNull().alias("leads")
    )


def _lost(edges: DataFrame) -> DataFrame:
    return edges.where("leads").select(F.col("later").alias("item")).distinct()


def followers(edges: DataFrame) -> DataFrame:
    """``item`` for every item that does not lead.

    ``edges`` has ``earlier, later``, directed along the order. Items without
    edges need no rounds and are leaders. The number of rounds is at most the
    longest chain of names that each depend on the one before; each round writes
    the edges that are still open, which shrink quickly, and the items it decides.
    The driver only keeps their folders: joins merge, so it builds no table to
    broadcast, and the result is one scan, however many rounds there were.
    """
    spark = edges.sparkSession
    still_open = edges.select("earlier", "later").distinct()
    decided: list[str] = []
    while True:
        still_open = materialize(_with_heads(still_open), "edges")
        found = _lost(still_open)
        decided.append(scratch_path(spark, "lost"))
        found.write.parquet(decided[-1])
        reader = spark.read.schema(found.schema)
        if still_open.isEmpty():
            return reader.parquet(*decided)
        lost = reader.parquet(decided[-1]).hint("merge")
        still_open = (
            still_open.select("earlier", "later")
            .join(lost.withColumnRenamed("item", "earlier"), "earlier", "left_anti")
            .join(lost.withColumnRenamed("item", "later"), "later", "left_anti")
        )
