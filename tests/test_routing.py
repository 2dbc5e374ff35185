from pyspark.sql import functions as F

from tagloom.functions.errors import backoff_seconds, classify_error
from tagloom.streaming.routing import retry_messages, route

KINDS = [
    ("AiError 3040 and 429", "capacity", "retry", 60),
    ("Capacity temporarily exceeded", "capacity", "retry", 60),
    ("Too many API requests", "rate_limit", "retry", 60),
    ("rate limit; timeout", "rate_limit", "retry", 60),
    ("HTTP 429", "rate_limit", "retry", 60),
    ("network down, not found", "transient", "retry", 60),
    ("503", "transient", "retry", 60),
    ("Snippet 7 not found", "missing", "ack", None),
    ("anything", "other", "retry", 60),
    (None, "unknown", "retry", 60),
]


def test_backoff(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 0, None)], "n int")
    got = [r["s"] for r in rows.select(backoff_seconds(F.col("n")).alias("s")).collect()]
    assert got == [30, 60, 120, 240, 300, 300, 30, 30]


def test_first_matching_kind_wins(spark):
    rows = spark.createDataFrame([(m,) for m, *_ in KINDS], "m string")
    got = rows.select("m", classify_error(F.col("m"), F.lit(2)).alias("c")).collect()
    assert [(r["m"], r["c"]["kind"], r["c"]["action"], r["c"]["delay_seconds"]) for r in got] == KINDS


def test_three_retries_then_a_dead_letter(spark):
    rows = spark.createDataFrame(
        [("a", n, "timeout", True) for n in range(1, 6)] + [("b", 1, None, False)],
        "snippet_id string, attempts int, error string, failed boolean",
    )
    routed = route(rows, 1000)
    got = [(r["snippet_id"], r["attempts"], r["action"], r["next_at"]) for r in routed.collect()]
    assert got == [
        ("a", 1, "retry", 61000), ("a", 2, "retry", 61000), ("a", 3, "retry", 61000),
        ("a", 4, "dead_letter", None), ("a", 5, "dead_letter", None), ("b", 1, "ack", None),
    ]
    again = retry_messages(routed, 0, 61000).collect()
    assert sorted(r["attempts"] for r in again) == [2, 3, 4]
    assert retry_messages(routed, 61000, 99000).isEmpty()
