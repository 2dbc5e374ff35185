"""The queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.bpe import code_documents
from tagloom.llm.common import sha256_hex, table
from tagloom.llm.conversation_repair import damage, repair_conversations
from tagloom.llm.fingerprints import fingerprint_edits
from tagloom.llm.hard_negatives import mine_hard_negatives
from tagloom.llm.html_extract import extract_pages
from tagloom.llm.license_scan import scan_licenses
from tagloom.llm.line_dedup import dedup_lines
from tagloom.llm.mixing import mix_documents
from tagloom.llm.ngram_join import similar_components
from tagloom.llm.quality_rules import judge_quality
from tagloom.llm.token_files import read_token_files, write_token_files
from tagloom.llm.toxicity import score_documents
from tagloom.llm.url_filters import judge_urls
from tagloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def word_bpe() -> str:
    """Vocabulary file that every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_document_fingerprints(spark, sf):
    return fingerprint_edits(table(spark, sf, "documents"))


@query
def op2_html_extraction(spark, sf):
    return extract_pages(table(spark, sf, "pages"))


@query
def op3_bpe_coding(spark, sf):
    return code_documents(table(spark, sf, "documents"), word_bpe()).select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op4_license_scan(spark, sf):
    return scan_licenses(table(spark, sf, "documents"))


@query
def op5_line_dedup(spark, sf):
    return dedup_lines(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256")
    )


@query
def op6_quality_rules(spark, sf):
    return judge_quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query
def op7_ngram_jaccard_join(spark, sf):
    return similar_components(table(spark, sf, "documents"), size=3, percent=90)


@query
def op8_toxicity(spark, sf):
    return score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_url_filters(spark, sf):
    return judge_urls(table(spark, sf, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


# Domains of the labelled table, the shares of tokens that they should have, and
# the wanted total over the present one.
DOMAINS = ("good", "poor")
WEIGHTS = (0.88, 0.12)
GROWTH = 1.2


def domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and the number of its domain, by quality; others are left out."""
    domain = F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


@query
def op10_source_mixing(spark, sf):
    mixed = mix_documents(
        table(spark, sf, "documents"), domains(table(spark, sf, "labels")), WEIGHTS, GROWTH
    )
    shares = (F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(DOMAINS))
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


@query
def op11_hard_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


# Ends every document on file.
END_ID = 1


@query
def op12_token_files(spark, sf):
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), folder, word_bpe(), END_ID)
    return read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op13_conversation_repair(spark, sf):
    conversations = table(spark, sf, "conversations")
    return repair_conversations(damage(conversations), conversations)


@query
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
