"""Tables of the tagging domain, derived from the given tables in full."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.config import WORD
from tagloom.functions.predicates import is_tagged, is_untagged
from tagloom.functions.text import words
from tagloom.operators.matching import exact_match
from tagloom.operators.paging import numbered
from tagloom.operators.propose import Facet, explode_names, top_terms
from tagloom.session import materialize

FACETS = (
    Facet(0, "Short words of this text:\n"),
    Facet(1, "Middle words of this text:\n"),
    Facet(2, "Long words of this text:\n"),
)
FACET_NUMBERS = [f.number for f in FACETS]
UNKNOWN_ID = 9_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key(number: str) -> Column:
    """Numeric ids as texts that sort like the numbers."""
    return F.lpad(F.col(number).cast("string"), 10, "0")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(key("doc_id").alias("id"), "text")


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as snippets; labels say which are tagged, empty or untried.

    Labels are many small rows, a multiple of their file once broadcast: they are merged.
    """
    labels = table(spark, sf, "labels")
    tags = F.when(F.col("quality") == 0, "[]").when(
        F.col("quality") == 1,
        F.concat(F.lit("["), (F.col("toxic") + 1).cast("string"), F.lit("]")),
    )
    return (
        table(spark, sf, "documents").drop("text")
        .join(labels.hint("merge"), "doc_id", "left")
        .select(
            key("doc_id").alias("id"),
            F.col("lang").alias("title"),
            F.col("source").alias("author"),
            F.col("doc_id").cast("int").alias("chapter_index"),
            F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
            .alias("source_url"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
            tags.alias("tags"),
        )
    )


def page_content(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as content objects; there are fewer than snippets."""
    return table(spark, sf, "pages").select(
        key("page_id").alias("id"), F.col("html").alias("text")
    )


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    return explode_names(top_terms(docs(spark, sf), WORD))


def of_untagged(spark: SparkSession, sf: str, names: DataFrame | None = None) -> DataFrame:
    names = proposals(spark, sf) if names is None else names
    untagged = snippets(spark, sf).where(is_untagged(F.col("tags"))).select("id")
    return names.join(untagged, "id", "left_semi")


def vocabulary(spark: SparkSession, sf: str, names: DataFrame | None = None) -> DataFrame:
    """Names proposed by tagged snippets, in order of first use."""
    names = proposals(spark, sf) if names is None else names
    tagged = snippets(spark, sf).where(is_tagged(F.col("tags"))).select("id")
    named = (
        names.join(tagged, "id", "left_semi").groupBy("name")
        .agg(F.min(F.struct("id", "idx")).alias("first"), F.count("*").alias("usage_count"))
    )
    return numbered(named, "first", "place").select(
        F.col("place").cast("bigint").alias("id"),
        "name",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
        "usage_count",
    )


@dataclass(frozen=True)
class Base:
    """Proposals of all snippets and the vocabulary, each written once."""

    names: DataFrame
    tags: DataFrame


def base(spark: SparkSession, sf: str) -> Base:
    names = materialize(proposals(spark, sf), "names")
    return Base(names, materialize(vocabulary(spark, sf, names), "vocabulary"))


def assigned(base: Base) -> DataFrame:
    """``id, idx, name, tag_id``: proposals of all snippets that equal a tag."""
    return exact_match(base.names, base.tags)


def junction(base: Base) -> DataFrame:
    return assigned(base).select(F.col("id").alias("snippet_id"), "tag_id").distinct()


def tagged_snippets(spark: SparkSession, sf: str, base: Base) -> DataFrame:
    """Snippets whose list agrees with the junction, untried ones without."""
    lists = (
        assigned(base).groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "tag_id"))).alias("l"))
        .select("id", F.to_json(F.transform("l", lambda e: e["tag_id"])).alias("list"))
    )
    rows = snippets(spark, sf)
    new = F.when(F.col("tags").isNotNull(), F.coalesce("list", F.lit("[]")))
    return rows.join(lists, "id", "left").withColumn("tags", new).select(*rows.columns)


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark passages; the facet follows from the length."""
    size = F.length("term")
    facet = F.when(size <= 7, 0).when(size <= 9, 1).otherwise(2)
    return (
        table(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("term"))
        .where(F.col("term").rlike(WORD.valid)).distinct()
        .withColumn("facet", facet)
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as model replies with one word per line."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.replace("text", F.lit(" "), F.lit("\n")).alias("reply")
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as queue messages with the error of their last attempt, if any."""
    k = F.get_json_object("props", "$.k").cast("int")
    error = (
        F.when(k < 15, "AiError 3040: Capacity temporarily exceeded")
        .when(k < 30, "HTTP 429")
        .when(k < 45, "request timeout")
        .when(k < 60, "upstream answered 503")
        .when(k < 75, F.concat(F.lit("Snippet "), key("user_id"), F.lit(" not found")))
        .when(k < 90, "unexpected reply")
    )
    failed = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        "event_id",
        key("user_id").alias("snippet_id"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        .alias("timestamp"),
        F.lit("medium").alias("priority"),
        (F.floor(k / 20) + 1).cast("int").alias("attempts"),
        failed.alias("failed"),
        F.when(failed, error).alias("error"),
    )


def plan_replies(tags: DataFrame) -> DataFrame:
    """One planner reply per stem of the vocabulary, in several wrappings.

    The most used tag of a stem leads. Each list also names the leader itself
    and an unknown id, and some name the leader of the next stem.
    """
    entry = F.struct((-F.col("usage_count")).alias("rank"), "id", "name")
    stems = (
        tags.groupBy(F.substring("name", 1, 4).alias("stem"))
        .agg(F.sort_array(F.collect_list(entry)).alias("members"))
        .select(
            "stem",
            F.col("members")[0]["id"].alias("lead_id"),
            F.col("members")[0]["name"].alias("lead_name"),
            F.sort_array(
                F.transform(F.expr("slice(members, 2, size(members))"), lambda m: m["id"])
            ).alias("others"),
        )
    )
    in_order = W.orderBy("stem")
    placed = stems.select(
        "*",
        F.row_number().over(in_order).cast("bigint").alias("reply_no"),
        F.lead("lead_id").over(in_order).alias("next_lead"),
    )
    n = F.size("others")
    next_lead = F.when((n % 2 == 1) & F.col("next_lead").isNotNull(), F.array("next_lead"))
    ids = F.concat(
        F.array("lead_id"), "others",
        F.array((F.col("lead_id") + UNKNOWN_ID)),
        F.coalesce(next_lead, F.array().cast("array<bigint>")),
    )
    name = (
        F.when(n == 1, F.col("lead_name")).when(n == 2, F.concat("stem", F.lit("-1")))
        .otherwise(F.concat("stem", F.lit("ing")))
    )
    reason = F.when(n == 3, "").otherwise(F.concat(F.lit("stem "), "stem"))
    group = F.concat(
        F.lit('{"primary_tag_id": '), F.col("lead_id").cast("string"),
        F.lit(', "primary_tag_name": "'), name,
        F.lit('", "merge_tag_ids": ['), F.array_join(F.transform(ids, lambda i: i.cast("string")), ", "),
        F.lit('], "reason": "'), reason, F.lit('"'),
    )
    plain = F.concat(F.lit('{"consolidations": ['), group, F.lit("}]}"))
    kind = F.col("reply_no") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here is the plan: "), plain, F.lit(" Done.")))
        .when(kind == 2, F.concat(
            F.lit('{"consolidations": [ // groups\n'), group, F.lit(",}, ]}")))
        .when(kind == 3, F.concat(
            F.lit('{"consolidations": /* by stem */ ['), group, F.lit("}]}  ")))
        .otherwise(F.concat(F.lit('{"consolidations": ['), group))
    )
    return placed.select("reply_no", reply.alias("reply"))
