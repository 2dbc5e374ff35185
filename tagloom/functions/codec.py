"""JSON text of a tag-id list and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_IDS = "array<bigint>"


def tags_to_json(ids: Column) -> Column:
    return F.to_json(ids)


def tags_from_json(text: Column) -> Column:
    """Tag ids of a JSON array; NULL for NULL and for corrupt text."""
    return F.from_json(text, TAG_IDS)


def is_corrupt(text: Column) -> Column:
    """True where text is present but is not a JSON array of ids."""
    return text.isNotNull() & tags_from_json(text).isNull()
