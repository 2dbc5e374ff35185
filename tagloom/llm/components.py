"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (``a, b``): the smallest id reachable.

    Every round takes the smallest label among an id's neighbours and then the
    label of that label, so labels travel along doubled distances. Labels are
    written each round; minima are combined before they are exchanged, so an id
    with very many links costs no task more than others. Joins are by merging: broadcasts
    of every round would pile up in the driver's memory.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
        "labels",
    )
    while True:
        known = labels.select(F.col("id").alias("b"), F.col("component").alias("near"))
        nearest = both.join(known.hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("near").alias("near")
        )
        stepped = labels.join(nearest.hint("merge"), "id").select(
            "id", F.col("component").alias("before"),
            F.least("component", "near").alias("next"),
        )
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        moved = materialize(
            stepped.join(jump.hint("merge"), "next", "left").select(
                "id", "before", F.least("next", F.coalesce("beyond", "next")).alias("component")
            ),
            "labels",
        )
        changed = moved.where(F.col("before") != F.col("component")).limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
