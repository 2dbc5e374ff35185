"""Edit similarity and the keys that find similar names by equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, else 1 - distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longer
    )


def allowed_edits(length: int, theta: float) -> int:
    """Edits two names may differ by when the longer one has ``length``.

    The small addend absorbs that (1 - 0.8) * 5 is just below 1 in doubles; the
    final word is always the similarity itself.
    """
    return math.floor((1.0 - theta) * length + EPSILON)


def first_length_with_edits(edits: int, theta: float) -> int:
    """Shortest length at which a pair may differ by ``edits``."""
    length = 1
    while allowed_edits(length, theta) < edits:
        length += 1
    return length


def shorter_by_one(texts: str) -> Column:
    """Each text of an array column with one character removed, no repeats."""
    return F.expr(f"""
        array_distinct(flatten(transform({texts}, t ->
            transform(sequence(1, length(t)), i ->
                concat(substr(t, 1, i - 1), substr(t, i + 1))))))
    """)
