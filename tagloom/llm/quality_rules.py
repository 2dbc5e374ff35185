"""Quality rules as a short-circuit cascade.

The rules' rejections and running times are measured on a bounded sample; a
rule's rank is its rejections per second. One CASE expression then runs the
rules in that order and stops at the first that rejects. The order changes the
work and which rule is named first, never whether a text is kept.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import BLANKS, UPPER, blank_words, long_hash, whole
from tagloom.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a bad text; null counts as false."""

    name: str
    rejects: Column


def word_counters(words: Column, text: Column) -> dict[str, Column]:
    """The counters of one text; ``words`` are its blank-separated words.

    A repeated window is found by sorting the hashed windows with their places
    and comparing neighbours; the words under repeated windows are counted from
    the distances between the sorted places. Work grows as n log n in the
    words of one text.
    """
    n = F.size(words)
    windows = F.when(n < WINDOW, F.array().cast("array<struct<h:bigint,at:int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
            lambda i: F.struct(long_hash(F.slice(words, i, WINDOW)).alias("h"), i.alias("at")),
        )
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_capitals": (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("bigint"),
        "windows": F.sort_array(windows),
    }


def repeated_words(windows: Column) -> Column:
    """Words under windows that occur twice; ``windows`` sorted by hash and place."""
    def same(a, b):
        return F.coalesce(F.get(windows, a)["h"] == F.get(windows, b)["h"], F.lit(False))

    places = F.array_sort(F.transform(
        F.filter(
            F.transform(windows, lambda x, i: F.struct(
                x["at"].alias("at"), (same(i, i - 1) | same(i, i + 1)).alias("twice"))),
            lambda x: x["twice"],
        ),
        lambda x: x["at"],
    ))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places, zero,
        lambda acc, at: F.struct(
            (acc["n"] + F.least(at - acc["last"], F.lit(WINDOW))).cast("bigint").alias("n"),
            at.alias("last"),
        ),
        lambda acc: acc["n"],
    )


def with_counters(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the counters of every row."""
    read = docs.select(F.col(id_col).alias("doc_id"), whole(text).alias("text"))
    split = read.withColumn("words", blank_words(F.col("text")))
    counted = split.select(
        "doc_id", *(c.alias(k) for k, c in word_counters(F.col("words"), F.col("text")).items())
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals",
        repeated_words(F.col("windows")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the counters: the base ones and those of common web filters."""
    n = F.col("n_words")
    return [
        Rule("few_words", n < 20),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 30 * n),
        Rule("symbols", 2 * F.col("n_symbols") > n),
        Rule("shouting", 2 * F.col("n_capitals") > F.col("word_chars")),
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 25 * n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
    ]


def cascade_order(
    docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text: str = "text",
) -> list[Rule]:
    """Rules by rejections per second on about ``sample_rows`` rows.

    Only the sampled texts are counted. With no rows to sample the given order
    stays.
    """
    total = docs.count()
    if not total or len(rules) < 2:
        return list(rules)
    sample = materialize(
        with_counters(docs.sample(min(1.0, sample_rows / total), 7), id_col, text), "rule-sample"
    )
    measured = []
    for place, rule in enumerate(rules):
        started = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.rejects)).first()[0]
        cost = time.perf_counter() - started
        measured.append((-rejected / cost, place, rule))
    return [rule for _, _, rule in sorted(measured, key=lambda m: m[:2])]


def first_rejection(rules: Sequence[Rule]) -> Column:
    """Name of the first rejecting rule, null if none: later rules don't run."""
    chain = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return chain


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Counters, ``base_failed`` and ``kept`` of every row.

    A null or empty text has no words and fails. Repeated rows are judged each.
    Other columns are not read.
    """
    rules = default_rules() if rules is None else list(rules)
    counted = with_counters(docs, id_col, text)
    ordered = cascade_order(docs, rules, sample_rows, id_col, text)
    return (
        counted.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & first_rejection(ordered).isNull())
    )
