"""Toxicity by a learned, weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: lower-cased, look-alike letters of other scripts and
digits or signs that stand in for letters become those letters. The lexicon holds
words and word beginnings that label-1 texts use significantly more often (a
likelihood-ratio test whose limit grows with the number of candidates), weighted
by their log odds. Of all entries that match at one word the heaviest counts; a
match inside an exception phrase doesn't. The summed weight and its density per
word go into a logistic score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import (
    release_worker,
    then_release,
    travels_with_tasks,
    whole,
    worker_cache,
)
from tagloom.session import materialize

TRAIN_ROWS = 40_000
MAX_ENTRIES = 20_000
BEGINNINGS = (4, 5, 6)
MIN_WEIGHT = 3.0

# Letters that look like Latin ones, and stand-ins for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ｏ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
# Phrases in which a word of abuse is none.
EXCEPTIONS = (
    "trash can", "trash bag", "trash bin", "trash collection", "clown fish", "class clown",
    "circus clown", "stupid simple", "sore loser", "good loser", "pond scum", "soap scum",
)

FOLD = str.maketrans(LOOK_ALIKES | DIGITS | {
    chr(c): chr(c - 0xFEE0) for c in range(0xFF21, 0xFF5B) if chr(c - 0xFEE0).isalpha()
} | dict.fromkeys(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)), ""))
INNER_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|+]+(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")
SIGN_TABLE = str.maketrans(SIGNS)


def fold(text: str) -> str:
    """Lower case with look-alikes, digits and signs inside words made letters."""
    text = text.lower().translate(FOLD)
    return INNER_SIGN.sub(lambda m: m[0].translate(SIGN_TABLE), text)


def terms_of(text: str) -> set[str]:
    """Candidate entries: `` word `` and `` beginning``, marked by the spaces."""
    words = set(WORD.findall(fold(text)))
    found = {f" {w} " for w in words if len(w) > 2}
    for size in BEGINNINGS:
        found.update(f" {w[:size]}" for w in words if len(w) >= size)
    return found


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS
) -> DataFrame:
    """``text`` and ``label`` of labelled rows that are not held out.

    Of more than ``rows`` labelled rows an even share is taken by a hash of the id.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id"))
    ).dropDuplicates(["doc_id"])
    total = known.count()
    if total > rows:
        # hashes are even, so this keeps the share rows / total
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        known = known.where(place < int((1 << 30) * rows / total))
    texts = docs.select("doc_id", whole("text").alias("text"))
    # the labels are no more than about ``rows``, whatever the size of the tables
    return materialize(
        texts.join(F.broadcast(known), "doc_id").select("text", "label"), "toxic-training"
    )


def _g2(a, b, n1, n0):
    """Likelihood ratio of a term in ``a`` of ``n1`` and ``b`` of ``n0`` texts."""
    expected = F.col("a") + F.col("b")
    share1, share0 = n1 / (n1 + n0), n0 / (n1 + n0)

    def part(seen, wanted):
        return F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)

    return 2 * (part(a, expected * share1) + part(b, expected * share0))


def learn_lexicon(
    rows: DataFrame, max_entries: int = MAX_ENTRIES
) -> dict[str, float]:
    """Weights of significant entries; none without texts of both labels.

    Counts are summed by term in a shuffle with partial sums; at most
    ``max_entries`` of the strongest come to the driver.
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(terms_of(t)))

    sizes = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in sizes}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = (
        rows.select("label", F.explode(terms("text")).alias("term"))
        .groupBy("term")
        .agg(F.sum("label").cast("double").alias("a"),
             F.sum(1 - F.col("label")).cast("double").alias("b"))
        .where((F.col("a") > 1) & (F.col("a") * n0 > F.col("b") * n1))
    )
    limit = 2 * math.log(20.0 * (n1 + n0) + 1000)
    odds = F.log(((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1)))
    strong = (
        counts.select("term", odds.alias("weight"), _g2(F.col("a"), F.col("b"), n1, n0).alias("g2"))
        .where((F.col("g2") > limit) & (F.col("weight") > MIN_WEIGHT))
        .orderBy(F.desc("g2"), "term").limit(max_entries)
    )
    return {r["term"]: r["weight"] for r in strong.collect()}


@dataclass(frozen=True)
class ToxicityModel:
    """``lexicon``: weights; ``logistic``: constant, summed weight, density."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    logistic: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float]] = {}
        for term, weight in self.lexicon.items():
            entries[term] = (len(term), weight)
        for phrase in self.exceptions:
            entries[f" {fold(phrase)} "] = (len(phrase) + 2, -1.0)
        for term, value in entries.items():
            machine.add_word(term, value)
        if entries:
            machine.make_automaton()
        return machine


def features(machine: ahocorasick.Automaton, texts: Iterable[str]) -> np.ndarray:
    """Per text: log of the summed weight, and weight per hundred words."""
    out = []
    for text in texts:
        words = WORD.findall(fold(text))
        total = 0.0
        if words and len(machine):
            line = f" {'  '.join(words)} "
            best: dict[int, float] = {}
            excepted: list[tuple[int, int]] = []
            # phrases have one space between words, the line has two
            for end, (size, weight) in machine.iter(line):
                start = end - size + 1
                best[start] = max(best.get(start, 0.0), weight)
            single = f" {' '.join(words)} "
            places = {}
            for end, (size, weight) in machine.iter(single):
                if weight < 0:
                    excepted.append((end - size + 1, end))
            if excepted:
                at, there = 0, 0
                for word in words:
                    places[at] = there
                    at, there = at + len(word) + 2, there + len(word) + 1
                # both in order: how far the exceptions that began so far reach
                excepted.sort()
                reach = began = 0
                for start in sorted(best):
                    spot = places.get(start)
                    if spot is None:
                        continue
                    while began < len(excepted) and excepted[began][0] <= spot:
                        reach = max(reach, excepted[began][1])
                        began += 1
                    if spot < reach:
                        del best[start]
            total = sum(best.values())
        out.append((math.log1p(total), 100 * total / (len(words) + 20)))
    return np.array(out, dtype=float).reshape(-1, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method on two features; few rows or one class give the prior."""
    if len(set(y.tolist())) < 2:
        return (-4.0, 1.0, 0.1)
    design = np.column_stack([np.ones(len(x)), x[:, 0], np.log1p(x[:, 1])])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> ToxicityModel:
    """Fits lexicon and score on at most about ``rows`` labelled rows."""
    known = training_rows(docs, labels, label, rows)
    lexicon = learn_lexicon(known)
    model = ToxicityModel(lexicon, tuple(exceptions))
    if not lexicon:
        return model

    def measure(batches):
        worker_cache("toxicity")
        machine = model.automaton()
        for batch in batches:
            x = features(machine, batch["text"])
            yield pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "label": batch["label"]})

    measured = known.mapInPandas(then_release(measure), "x0 double, x1 double, label int").toPandas()
    x, y = measured[["x0", "x1"]].to_numpy(), measured["label"].to_numpy(float)
    return ToxicityModel(lexicon, tuple(exceptions), fit_logistic(x, y))


def score_column(text: Column, model: ToxicityModel) -> Column:
    """Score between 0 and 1 of a text column; null as empty text."""
    constant, total, density = model.logistic

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("toxicity")
        machine = model.automaton()
        try:
            for texts in batches:
                # one text as a Python string at a time, not the batch
                x = features(machine, (text.as_py() for text in texts))
                z = constant + total * x[:, 0] + density * np.log1p(x[:, 1])
                yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        finally:
            release_worker()

    return score(whole(text))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Only the text is scored. Empty and null texts get the score of a text without
    matches; repeated rows are scored each; without labels of both kinds, or where
    no entry is significant, nothing is learned and all scores are low.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    model = learn(own, labels)
    return own.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"),
        score_column(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


travels_with_tasks(__name__)
