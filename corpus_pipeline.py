"""A training-data pipeline of five stages, each over all that the one before kept.

Toxic documents go; repeated lines go; of every group of near copies one document
stays; sources are mixed to target weights; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import toxicity as tox
from tagloom.llm.bpe import code_documents
from tagloom.llm.common import table
from tagloom.llm.line_dedup import dedup_lines
from tagloom.llm.mixing import mix_documents
from tagloom.llm.ngram_join import similar_components
from tagloom.llm.queries import GROWTH, WEIGHTS, domains, word_bpe
from tagloom.session import materialize

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit."""
    model = tox.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(tox.score_column(F.col("text"), model) < TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds.

    Documents that lose all their lines go as well. Rows of one id are one
    document and stay rows of their own; rows without an id lose nothing.
    """
    kept = dedup_lines(docs, carry="row").where(
        (F.col("n_dropped") == 0) | (F.col("text") != "")
    )
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return kept.select(*(
        changed.get(f.name, F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name)
        for f in docs.schema
    ))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies.

    Sets of five words, Jaccard similarity 0.8 and more. Rows of one id are one
    document and stay or go together; rows without an id are in no group and stay.
    """
    groups = similar_components(docs, size=5, percent=80)
    others = materialize(
        groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id"), "near-copies"
    )
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rates say, with or without an id."""
    mixed = mix_documents(
        docs, domains(table(spark, sf_dir, "labels")), WEIGHTS, GROWTH, carry="row"
    )
    repeated = mixed.where(F.col("copies") > 0).select(
        "row", F.explode(F.sequence(F.lit(1), "copies"))
    )
    return repeated.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (packed) and the text they decode to, a row each.

    A null text has no ids; an empty table gives no rows. Other columns end here.
    """
    return code_documents(docs, word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("source_mixing", mix_sources),
    ("bpe_coding", encode),
]

#: Learned scores are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; every result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
