"""Schemas of the stored tables, of queue messages and of outcomes."""

from __future__ import annotations

from pyspark.sql import types as T

SNIPPETS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("author", T.StringType(), False),
    T.StructField("chapter_index", T.IntegerType(), False),
    T.StructField("source_url", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("tags", T.StringType(), True),
])

TAGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("usage_count", T.LongType(), False),
])

SNIPPET_TAGS = T.StructType([
    T.StructField("snippet_id", T.StringType(), False),
    T.StructField("tag_id", T.LongType(), False),
])

CONTENT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
])

# ``timestamp`` is milliseconds since the epoch; ``attempts`` counts deliveries. ``run``
# is the time of the first of them, which tells the rounds of a snippet apart; a message
# without it begins a round of its own.
MESSAGES = T.StructType([
    T.StructField("snippet_id", T.StringType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("priority", T.StringType(), True),
    T.StructField("attempts", T.IntegerType(), True),
    T.StructField("run", T.LongType(), True),
])

TABLES = {"snippets": SNIPPETS, "tags": TAGS, "snippet_tags": SNIPPET_TAGS}
