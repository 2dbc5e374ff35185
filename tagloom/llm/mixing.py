"""Soft-membership mixing: document rates that match target weights of domains.

A naive Bayes classifier over hashed words and word endings, fitted and calibrated
on a bounded sample of a labelled table, gives every document a posterior over the
domains. A document's tokens count for each domain in proportion. The rates start
at one; projected gradient steps on the squared misfit of the expected domain
totals move them, scaled by the domains' overlap matrix so that steps have one
size in all directions. Rates always are the projection of ``1 + posterior .
theta`` to nonnegative numbers, so the state of the iteration is one number per
domain and a step is one aggregation over (tokens, posterior).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import release_worker, then_release, travels_with_tasks, whole, worker_cache
from tagloom.session import materialize

TRAIN_ROWS = 40_000
BINS = 1 << 16
CACHED_WORDS = 150_000
MAX_STEPS = 50
TOLERANCE = 1e-6


def word_bins(text: str | None) -> tuple[np.ndarray, int]:
    """Distinct bins of a text's words and of their last three bytes; its words."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    known = worker_cache("word-bins")
    if len(known) > CACHED_WORDS:
        known.clear()
    distinct = set(words)
    for word in distinct.difference(known):
        known[word] = (
            xxhash.xxh3_64_intdigest(word.lower()) % BINS,
            xxhash.xxh3_64_intdigest(b"\0" + word[-3:]) % BINS,
        )
    bins = np.array([known[w] for w in distinct], np.int64).ravel()
    return np.unique(bins), len(words)


@dataclass(frozen=True)
class DomainModel:
    """Log likelihoods by bin and domain, and the calibration of their means."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def evidence(self, bins: np.ndarray) -> np.ndarray:
        """Log likelihoods against their mean, growing as the root of the evidence."""
        if not len(bins):
            return np.zeros(self.table.shape[1])
        total = self.table[bins].sum(axis=0, dtype=float)
        return (total - total.mean()) / np.sqrt(len(bins))

    def posterior(self, evidence: np.ndarray) -> np.ndarray:
        z = evidence @ self.weights + self.bias
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, domain, fold`` of at most about ``rows`` labelled documents.

    ``labels`` has ``doc_id`` and ``domain``. Of more rows an even share is taken
    by a hash of the id.
    """
    known = labels.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("domain").cast("int").alias("domain"),
        F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)).cast("int").alias("fold"),
    ).dropDuplicates(["doc_id"])
    total = known.count()
    if total > rows:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        known = known.where(place < int((1 << 30) * rows / total))
    texts = docs.select("doc_id", whole("text").alias("text"))
    # no more than about ``rows`` ids, whatever the size of the tables
    return materialize(
        texts.join(F.broadcast(known), "doc_id").select("text", "domain", "fold"), "labelled"
    )


def fit_domains(rows: DataFrame, domains: int) -> DomainModel:
    """Naive Bayes on four folds, calibrated on the fifth.

    Only the table of counts (``BINS`` by domain) and the calibration rows'
    evidence come to the driver. Without rows all posteriors are equal.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((domains, BINS), np.int64)
        for batch in batches:
            for text, domain in zip(batch["text"], batch["domain"]):
                seen[domain][word_bins(text)[0]] += 1
        for domain in range(domains):
            bins = np.flatnonzero(seen[domain])
            yield pd.DataFrame({"domain": domain, "bin": bins, "seen": seen[domain][bins]})

    usable = rows.where(F.col("domain").between(0, domains - 1))
    counts = (
        usable.where(F.col("fold") != 0).mapInPandas(then_release(count), "domain int, bin long, seen long")
        .groupBy("domain", "bin").agg(F.sum("seen").alias("seen")).toPandas()
    )
    table = np.full((BINS, domains), 0.5)
    table[counts["bin"], counts["domain"]] += counts["seen"]
    table = np.log(table / table.sum(axis=0)).astype(np.float32)
    plain = DomainModel(table, np.eye(domains), np.zeros(domains))
    if counts.empty:
        return DomainModel(table * 0, plain.weights, plain.bias)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "evidence": [plain.evidence(word_bins(t)[0]) for t in batch["text"]],
                "domain": batch["domain"],
            })

    held = (
        usable.where(F.col("fold") == 0).mapInPandas(then_release(measure), "evidence array<double>, domain int")
        .toPandas()
    )
    return _calibrated(plain, held, domains)


def _calibrated(model: DomainModel, held: pd.DataFrame, domains: int) -> DomainModel:
    """Multinomial logistic regression of the domain on the evidence."""
    if held.empty:
        return model
    x = np.stack(held["evidence"].to_numpy())
    y = np.eye(domains)[held["domain"].to_numpy()]
    weights, bias = np.eye(domains), np.log((y.sum(axis=0) + 1) / (len(y) + domains))
    step = 2.0 / (np.square(x).sum(axis=1).mean() + 1)
    for _ in range(2_000):
        miss = DomainModel(model.table, weights, bias).posterior(x) - y
        weights = weights - step * (x.T @ miss / len(x) + 1e-4 * weights)
        bias = bias - step * miss.mean(axis=0)
    return DomainModel(model.table, weights, bias)


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``n_tokens`` (words) and ``posterior`` behind the other columns than ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.weights, model.bias))

    @F.pandas_udf("n_tokens long, posterior array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = DomainModel(*shared.value)
        try:
            for texts in batches:
                # a batch's bins take more room than its texts, so none wait for the others
                found = [(own.evidence(bins), n) for bins, n in map(word_bins, texts)]
                evidence = np.array([e for e, _ in found])
                evidence = evidence.reshape(len(found), -1)
                yield pd.DataFrame({
                    "n_tokens": np.array([n for _, n in found], np.int64),
                    "posterior": list(own.posterior(evidence)),
                })
        finally:
            release_worker()

    kept = [c for c in docs.columns if c != "text"]
    return docs.withColumn("found", predict(whole("text"))).select(*kept, "found.*")


def rate(posterior: Column, theta: Sequence[float]) -> Column:
    """The rate of a posterior: projected to nonnegative numbers."""
    moved = F.lit(1.0)
    for k, value in enumerate(theta):
        moved = moved + posterior[k] * F.lit(float(value))
    return F.greatest(moved, F.lit(0.0))


def fit_rates(
    members: DataFrame, weights: Sequence[float], growth: float = 1.0,
    steps: int = MAX_STEPS, tolerance: float = TOLERANCE,
) -> list[float]:
    """``theta`` for which expected domain totals match ``weights``.

    ``growth`` is the wanted total over the present one. Stops when no domain
    misses its share by more than ``tolerance`` of the total, or after ``steps``;
    targets that no rates can reach are then approached as far as that.
    """
    domains = len(weights)
    tokens, posterior = F.col("n_tokens"), F.col("posterior")
    sums = [F.sum(tokens * posterior[k] * posterior[j]).alias(f"g{k}_{j}")
            for k in range(domains) for j in range(domains)]
    first = members.agg(F.sum("n_tokens").alias("n"), *sums).first()
    total = first["n"] or 0
    if not total:
        return [0.0] * domains
    overlap = np.array(first[1:], float).reshape(domains, domains) / total
    scale = np.linalg.inv(overlap + 1e-6 * np.eye(domains))
    target = growth * np.array(weights, float) / sum(weights)
    theta = np.zeros(domains)
    for _ in range(steps):
        reached = members.agg(*(
            F.sum(tokens * posterior[k] * rate(posterior, theta)) for k in range(domains)
        )).first()
        gradient = np.array(reached, float) / total - target
        if np.abs(gradient).max() <= tolerance:
            break
        theta = theta - scale @ gradient
    return theta.tolist()


def copies(rates: Column, spread: Column) -> Column:
    """The rate rounded up or down by a hash, right on average."""
    even = F.pmod(spread, F.lit(1 << 30)) / (1 << 30)
    return F.floor(rates + even).cast("int")


def mix_documents(
    docs: DataFrame, labels: DataFrame, weights: Sequence[float], growth: float = 1.0,
    id_col: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS,
    carry: str | None = None,
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``posterior``, ``rate`` and ``copies`` of every row.

    ``labels`` has ``doc_id`` and ``domain`` (0, 1, ... as in ``weights``). Null and
    empty texts have no tokens and the posterior of no evidence. Repeated rows get
    equal results. Rates are rounded by a hash of the id, without an id by one of
    the text. Other columns are not read, unless ``carry`` names a column that
    holds the input row. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    model = fit_domains(labelled_rows(own, labels, train_rows), len(weights))
    rest = [] if carry is None else [
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(carry)
    ]
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(3), whole(text)))
        .otherwise(F.xxhash64(F.lit(3), F.col(id_col).cast("bigint"))).alias("spread"),
        *rest,
    )
    members = materialize(with_posteriors(rows, model), "members")
    theta = fit_rates(members, weights, growth)
    return members.withColumn("rate", rate(F.col("posterior"), theta)).select(
        "doc_id", "n_tokens", "posterior", "rate",
        copies(F.col("rate"), F.col("spread")).alias("copies"),
        *([] if carry is None else [carry]),
    )


travels_with_tasks(__name__)
