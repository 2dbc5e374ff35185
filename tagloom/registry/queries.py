"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.config import BATCH_SIZE, CJK2, CHUNK_SIZE, WORD
from tagloom.functions import plan_text
from tagloom.functions.codec import is_corrupt, tags_from_json, tags_to_json
from tagloom.functions.errors import backoff_seconds, classify_error
from tagloom.functions.predicates import after, is_tagged, is_untagged, snippet_by_id
from tagloom.functions.similarity import similarity
from tagloom.functions.text import (
    clean_tag,
    combine_passes,
    parse_reply,
    truncate_text,
    valid_tag,
)
from tagloom.operators import consolidate as con
from tagloom.operators import merge_plans as mp
from tagloom.operators import paging, reports
from tagloom.operators.integrity import integrity_report
from tagloom.operators.keyed import (
    insert_or_ignore,
    replace_pairs,
    snippet_arrays,
    snippets_with_tags,
)
from tagloom.operators.matching import best_match, exact_match, fuzzy_pairs
from tagloom.operators.propose import (
    facet_prompts,
    propose_with_lexicon,
    propose_with_model,
)
from tagloom.operators.vocabulary import assign_tags, grow_vocabulary
from tagloom.plans import maintenance
from tagloom.plans.tagging import (
    Settings,
    lexicon_proposer,
    tag_batch,
    terms_proposer,
)
from tagloom.registry import views as v
from tagloom.session import materialize, scratch_path
from tagloom.sources.content import missing_content, with_content
from tagloom.sources.messages import as_messages, dead_letters, enqueue, read_messages
from tagloom.sources.schemas import TABLES
from tagloom.sources.tables import TableStore
from tagloom.streaming.loop import Queue
from tagloom.streaming.progress import backlog, progress
from tagloom.streaming.routing import retry_messages, route
from tagloom.streaming.tagging import fold_stream, start_tagging_stream, write_outcomes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAGE = BATCH_SIZE
CURSOR = "0000000099"
POINT = "0000000042"
OFFSET = 100
COSINE = 0.35
JACCARD = 0.5
SMALL_CAP = 1000
# Above every derived vocabulary, so that growing has room.
ROOM = 10_000_000


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def as_text(ids: Column | str) -> Column:
    """Lists are compared as joined text."""
    items = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(F.transform(items, lambda i: i.cast("string")), ",")


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# -- sources and sinks ----------------------------------------------------------
@query
def scan_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return v.snippets(spark, sf).withColumn("created_at", F.col("created_at").cast("string"))


@query
def scan_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return v.vocabulary(spark, sf).select("id", "name", "usage_count")


@query
def scan_junction(spark: SparkSession, sf: str) -> DataFrame:
    return v.junction(v.base(spark, sf))


@query
def content_join(spark: SparkSession, sf: str) -> DataFrame:
    known = v.snippets(spark, sf).select("id", "title")
    return with_content(known, v.page_content(spark, sf))


@query
def missing_content_errors(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.table(spark, sf, "events").select(v.key("event_id").alias("id"))
    return missing_content(ids, v.snippets(spark, sf), v.page_content(spark, sf))


def _store(spark: SparkSession, name: str) -> TableStore:
    return TableStore(spark, scratch_path(spark, name))


def _filled_store(spark: SparkSession, sf: str, name: str) -> TableStore:
    """Tables as they stand after the labelled snippets were tagged."""
    store = _store(spark, name)
    base = v.base(spark, sf)
    store.publish(
        {
            "snippets": v.tagged_snippets(spark, sf, base),
            "tags": base.tags,
            "snippet_tags": v.junction(base),
        },
        high_water=base.tags.agg(F.max("id")).first()[0],
    )
    return store


@query
def init_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Tables made twice and filled once: rows per table."""
    store = _store(spark, "init")
    store.init_tables()
    store.publish({"snippets": v.snippets(spark, sf)})
    tables = store.init_tables()
    counts = [
        tables.read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        for name in TABLES
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def publish_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets published twice, the second time from what is being read."""
    store = _store(spark, "publish")
    store.publish({"snippets": v.snippets(spark, sf)})
    empty = F.when(is_untagged(F.col("tags")), F.lit("[]")).otherwise(F.col("tags"))
    store.publish({"snippets": store.read_snippets().withColumn("tags", empty)})
    return store.read_snippets().select("id", "author", "tags")


@query
def integrity_audit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    pairs = v.table(spark, sf, "events").select(
        v.key("user_id").alias("snippet_id"), k.alias("tag_id")
    )
    return integrity_report(v.snippets(spark, sf), v.vocabulary(spark, sf), pairs)


@query
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Tags used once and short snippets deleted: the pairs, with what is left of tags."""
    store = _filled_store(spark, sf, "delete")
    tables = store.snapshot()
    used_once = tables.tags.where(F.col("usage_count") == 1).select("id")
    short = v.docs(spark, sf).where(F.length("text") < 500).select("id")
    maintenance.delete_rows(store, snippets=short, tags=used_once)
    after = store.snapshot()
    tags = after.tags.select(F.col("id").alias("tag_id"), "usage_count")
    snippets = after.snippets.select(F.col("id").alias("snippet_id"), "author")
    return after.snippet_tags.join(tags, "tag_id", "full").join(snippets, "snippet_id", "left")


@query
def stream_source(spark: SparkSession, sf: str) -> DataFrame:
    """All messages through a stream: what came out per snippet."""
    queue = scratch_path(spark, "queue")
    v.messages(spark, sf).select("snippet_id", "timestamp", "priority", "attempts").write.parquet(queue)
    out, marks = scratch_path(spark, "drained"), scratch_path(spark, "marks")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream = read_messages(spark, queue).writeStream.foreachBatch(keep)
    stream.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("snippet_id").agg(
        F.count("*").alias("n_messages"),
        F.max("timestamp").alias("last_timestamp"),
        big(F.max("attempts")).alias("most_attempts"),
    )


@query
def enqueue_messages(spark: SparkSession, sf: str) -> DataFrame:
    waiting = backlog(v.snippets(spark, sf))
    queued = as_messages(waiting, 1704067200000).drop("run")
    return queued.withColumn("attempts", big("attempts"))


@query
def tags_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    lists = v.tagged_snippets(spark, sf, v.base(spark, sf)).select("id", "tags")
    broken = F.when(F.col("tags") == "[]", F.lit("[1,")).otherwise(F.col("tags"))
    ids = tags_from_json(broken)
    return lists.select(
        "id",
        tags_to_json(ids).alias("json"),
        as_text(ids).alias("ids"),
        is_corrupt(broken).alias("corrupt"),
    )


# -- predicates -----------------------------------------------------------------
@query
def untagged(spark: SparkSession, sf: str) -> DataFrame:
    return v.snippets(spark, sf).where(is_untagged(F.col("tags"))).select("id", "tags")


@query
def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return v.snippets(spark, sf).where(is_tagged(F.col("tags"))).select("id", "tags")


@query
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return snippet_by_id(v.snippets(spark, sf), POINT).select("id", "title", "author", "tags")


@query
def keyset_filter(spark: SparkSession, sf: str) -> DataFrame:
    return after(v.snippets(spark, sf), CURSOR).select("id", "tags")


# -- paging ---------------------------------------------------------------------
@query
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    page = paging.next_page(v.snippets(spark, sf), PAGE, CURSOR)
    return paging.page_cursor(page).withColumn("batch_size", F.lit(PAGE).cast("bigint"))


@query
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return paging.offset_page(v.snippets(spark, sf), CHUNK_SIZE, OFFSET).select("id")


@query
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    return paging.chunk_plan(backlog(v.snippets(spark, sf)))


@query
def tags_listing(spark: SparkSession, sf: str) -> DataFrame:
    listed = reports.list_tags(v.vocabulary(spark, sf))
    return listed.withColumn("created_at", F.col("created_at").cast("string"))


@query
def top_n_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return v.proposals(spark, sf).withColumn("idx", big("idx"))


@query
def fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    batches = paging.batches_of(backlog(v.snippets(spark, sf)))
    return batches.select("batch", F.array_join("ids", ",").alias("ids"))


# -- reports --------------------------------------------------------------------
@query
def status(spark: SparkSession, sf: str) -> DataFrame:
    return reports.status(v.snippets(spark, sf), v.vocabulary(spark, sf))


@query
def queue_status(spark: SparkSession, sf: str) -> DataFrame:
    report = reports.queue_status(v.snippets(spark, sf), v.vocabulary(spark, sf))
    return report.select(
        "total_snippets", "total_tags", "tagged_snippets", "pending_snippets",
        "percent", "status", big(F.size("hints")).alias("n_hints"),
    )


@query
def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    grown = reports.apply_usage(base.tags, reports.usage_increments(v.assigned(base)))
    return grown.select("id", "name", "usage_count")


@query
def clear_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.clear_summary(v.snippets(spark, sf), v.vocabulary(spark, sf))


@query
def usage_drift(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    return reports.usage_drift(base.tags, v.junction(base))


def _queue_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Backlog ids; those without a page count as failed."""
    pages = v.page_content(spark, sf).select("id", F.lit(True).alias("found"))
    return backlog(v.snippets(spark, sf)).select("id").join(pages, "id", "left").select(
        "id", F.coalesce("found", F.lit(False)).alias("ok")
    )


@query
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    uses = v.assigned(v.base(spark, sf)).groupBy("id").agg(F.count("*").alias("existing_tags"))
    error = F.when(~F.col("ok"), "no page")
    outcomes = _queue_outcomes(spark, sf).join(uses, "id", "left").select(
        "id", error.alias("error"),
        F.lit(0).cast("bigint").alias("new_tags"),
        F.when(F.col("ok"), F.coalesce("existing_tags", F.lit(0))).otherwise(0)
        .alias("existing_tags"),
    )
    return reports.run_stats(outcomes)


@query
def chunk_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.chunk_totals(paging.assign_chunks(_queue_outcomes(spark, sf)))


# -- joins ----------------------------------------------------------------------
@query
def exact_match_tags(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    found = exact_match(base.names.withColumn("name", F.initcap("name")), base.tags)
    return found.withColumn("idx", big("idx"))


def _name_pairs(base: v.Base) -> DataFrame:
    names = base.names.select("name").distinct()
    return fuzzy_pairs(names, base.tags.select("name"))


@query
def fuzzy_name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _name_pairs(v.base(spark, sf))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query
def best_match_tags(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    best = best_match(_name_pairs(base), base.tags)
    return best.withColumn("similarity", F.round("similarity", 6))


@query
def snippets_with_any_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets holding a tag that is used more than once."""
    base = v.base(spark, sf)
    popular = base.tags.where(F.col("usage_count") > 1)
    return snippets_with_tags(v.snippets(spark, sf), v.junction(base), popular).select("id")


@query
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """The junction plus the ids that labels give to snippets."""
    listed = v.snippets(spark, sf).where(is_tagged(F.col("tags")))
    new = listed.select(
        F.col("id").alias("snippet_id"), F.explode(tags_from_json(F.col("tags"))).alias("tag_id")
    )
    return insert_or_ignore(v.junction(v.base(spark, sf)), new, ["snippet_id", "tag_id"])


# -- text -----------------------------------------------------------------------
@query
def truncate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return v.docs(spark, sf).select("id", truncate_text(F.col("text")).alias("shown"))


@query
def facet_prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    prompts = facet_prompts(v.docs(spark, sf), v.FACETS)
    return prompts.withColumn("facet", big("facet"))


@query
def model_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic stand-in for a model, which fails on cut texts."""

    def load():
        def reply(prompts: list[str]) -> list[str]:
            if any(p.endswith("...") for p in prompts):
                raise ValueError("timeout while reading a long text")
            return [f"{len(p)}\n{p[:5]}" for p in prompts]

        return reply

    answered = propose_with_model(facet_prompts(v.docs(spark, sf), v.FACETS), load)
    return answered.withColumn("facet", big("facet"))


@query
def lexicon_proposals(spark: SparkSession, sf: str) -> DataFrame:
    found = propose_with_lexicon(
        v.docs(spark, sf), v.lexicon(spark, sf), v.FACET_NUMBERS
    )
    return found.select("id", F.array_join("names", ",").alias("names"))


@query
def parse_replies(spark: SparkSession, sf: str) -> DataFrame:
    return v.replies(spark, sf).select(
        "conv_id", "turn",
        F.array_join(parse_reply(F.col("reply"), WORD), ",").alias("names"),
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    text = v.table(spark, sf, "conversations")
    return text.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query
def clean_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(
        "conv_id", "turn", big("pos").alias("pos"),
        clean_tag(F.col("line"), WORD).alias("word"),
        clean_tag(F.col("line"), CJK2).alias("cjk2"),
    )


@query
def valid_tags(spark: SparkSession, sf: str) -> DataFrame:
    found = v.replies(spark, sf).select(
        "conv_id", "turn", F.explode(F.split("reply", "\n")).alias("line")
    )
    cleaned = clean_tag(F.col("line"), WORD)
    judged = found.select(
        "conv_id", "turn",
        valid_tag(cleaned, WORD).alias("word"),
        valid_tag(clean_tag(F.col("line"), CJK2), CJK2).alias("cjk2"),
    )
    return judged.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_lines"),
        F.count_if("word").alias("n_word"),
        F.count_if("cjk2").alias("n_cjk2"),
    )


@query
def combine_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Passes over a reply as it is, in lower case, and from the end."""
    reply = F.col("reply")
    backwards = F.array_join(F.reverse(F.split(reply, "\n")), "\n")
    passes = [parse_reply(r, WORD) for r in (reply, F.lower(reply), backwards)]
    return v.replies(spark, sf).select(
        "conv_id", "turn", F.array_join(combine_passes(*passes), ",").alias("names")
    )


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each proposal of a snippet with the next one."""
    in_order = W.partitionBy("id").orderBy("idx")
    paired = v.proposals(spark, sf).withColumn("other", F.lead("name").over(in_order))
    return paired.where(F.col("other").isNotNull())


@query
def edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select(
        "id", big("idx").alias("idx"), big(F.levenshtein("name", "other")).alias("distance")
    )


@query
def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    alike = similarity(F.col("name"), F.col("other"))
    return _neighbours(spark, sf).select(
        "id", big("idx").alias("idx"), F.round(alike, 6).alias("similarity")
    )


# -- vocabulary and assignment ----------------------------------------------------
def _grown(spark: SparkSession, sf: str, **limits) -> DataFrame:
    base = v.base(spark, sf)
    names = v.of_untagged(spark, sf, base.names)
    return grow_vocabulary(names, base.tags, **{"max_tags": ROOM, **limits})


def _new_tag_columns(grown: DataFrame) -> DataFrame:
    return grown.select(
        F.col("tag_id").alias("id"), "name", "born_id", big("born_idx").alias("born_idx")
    )


@query
def grow_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return _new_tag_columns(_grown(spark, sf))


@query
def vocab_cap(spark: SparkSession, sf: str) -> DataFrame:
    return _new_tag_columns(_grown(spark, sf, max_tags=SMALL_CAP))


@query
def allocate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Exact matching only, behind ids that were given out and cleared."""
    grown = grow_vocabulary(
        v.of_untagged(spark, sf), spark.createDataFrame([], "id bigint, name string"),
        theta=1.0, high_water=v.UNKNOWN_ID, max_tags=ROOM,
    )
    return _new_tag_columns(grown)


def _assigned(spark: SparkSession, sf: str, base: v.Base) -> DataFrame:
    names = materialize(v.of_untagged(spark, sf, base.names), "open-names")
    new = grow_vocabulary(names, base.tags, max_tags=ROOM)
    return assign_tags(names, base.tags, new)


@query
def assign_tags_to_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, v.base(spark, sf)).select(
        "id", big("idx").alias("idx"), "tag_id",
        F.round("similarity", 6).alias("similarity"), "is_new",
    )


@query
def snippet_tag_arrays(spark: SparkSession, sf: str) -> DataFrame:
    waiting = backlog(v.snippets(spark, sf)).select("id")
    arrays = snippet_arrays(waiting, _assigned(spark, sf, v.base(spark, sf)))
    return arrays.select("id", tags_to_json(F.col("tag_ids")).alias("tags"))


@query
def replace_junction(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    waiting = backlog(v.snippets(spark, sf)).select("id")
    return replace_pairs(v.junction(base), waiting, _assigned(spark, sf, base))


@query
def tag_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: tag everything untagged from a lexicon, publish, list the tags."""
    store = _store(spark, "backlog")
    store.publish({"snippets": v.snippets(spark, sf)})
    proposer = lexicon_proposer(v.lexicon(spark, sf), v.FACET_NUMBERS)
    tag_batch(store, v.docs(spark, sf), proposer, Settings(WORD, max_tags=ROOM), batch_size=None)
    return reports.list_tags(store.read_tags()).select("id", "name", "usage_count")


# -- consolidation ----------------------------------------------------------------
def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return v.plan_replies(v.vocabulary(spark, sf))


@query
def planner_input(spark: SparkSession, sf: str) -> DataFrame:
    return mp.planner_input(v.vocabulary(spark, sf))


@query
def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select(
        "reply_no", plan_text.extract_json(F.col("reply")).alias("json")
    )


@query
def scrub_json(spark: SparkSession, sf: str) -> DataFrame:
    found = plan_text.extract_json(F.col("reply"))
    return _replies(spark, sf).select(
        "reply_no", plan_text.scrub_json(found).alias("json")
    )


@query
def parse_plan(spark: SparkSession, sf: str) -> DataFrame:
    return mp.plan_groups(_replies(spark, sf)).select(
        "reply_no", "group_no", F.col("primary_tag_id").alias("primary_id"),
        "primary_tag_name",
        as_text("merge_tag_ids").alias("merge_ids"),
        "reason",
    )


def _groups(base: v.Base) -> DataFrame:
    """The planner's groups for the vocabulary, its replies written once."""
    return mp.plan_groups(materialize(v.plan_replies(base.tags), "replies"))


@query
def plan_resolve(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    resolved = mp.resolve_plan(_groups(base), base.tags)
    return resolved.select("reply_no", "primary_id", "pos", "merge_id")


@query
def valid_groups(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    return mp.resolve_overlaps(mp.valid_groups(_groups(base), base.tags)).select(
        "reply_no", "primary_id", "suggested_name", "reason", "pos", "merge_id", "verdict"
    )


def _mapping(base: v.Base) -> DataFrame:
    groups = mp.valid_groups(_groups(base), base.tags)
    return materialize(mp.merge_mapping(mp.resolve_overlaps(groups)), "mapping")


@query
def rename_primary_tags(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    asked = mp.renames(_mapping(base), base.tags, WORD)
    renamed = con.rename_tags(base.tags, asked).select(F.col("id").alias("primary_id"), "name")
    return asked.join(renamed, "primary_id").select(
        "reply_no", "primary_id", "suggested_name", "new_name", "verdict", "name"
    )


@query
def remap_junction(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    return con.remap_pairs(v.junction(base), _mapping(base))


@query
def rewrite_arrays(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    rows = v.tagged_snippets(spark, sf, base)
    return con.rewrite_arrays(rows, v.junction(base), _mapping(base)).select("id", "tags")


@query
def rollup_usage(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    return con.rollup_usage(base.tags, _mapping(base)).select("id", "name", "usage_count")


def _report_columns(report: DataFrame) -> DataFrame:
    return report.select(
        "reply_no", "primary_id", as_text("merged_ids").alias("merged_ids"),
        "snippets_updated", "reason",
    )


@query
def consolidation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of a consolidation that was applied and published."""
    store = _filled_store(spark, sf, "consolidate")
    plan = v.plan_replies(store.read_tags())
    done = maintenance.consolidate(store, plan, profile=WORD)
    return _report_columns(done.report)


@query
def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What a dry run leaves behind: the tables as they were, and the plan."""
    store = _filled_store(spark, sf, "dry-run")
    plan = maintenance.consolidate(
        store, v.plan_replies(store.read_tags()), profile=WORD, dry_run=True
    )
    merges = plan.mapping.select(F.col("merge_id").alias("id"), "primary_id")
    return store.read_tags().join(merges, "id", "left").select(
        "id", "name", "usage_count", "primary_id"
    )


def _star_columns(groups: DataFrame) -> DataFrame:
    return groups.select("primary_id", "primary_name", "pos", "merge_id", "reason")


@query
def plan_edit(spark: SparkSession, sf: str) -> DataFrame:
    tags = v.base(spark, sf).tags
    return _star_columns(mp.plan_by_similarity(tags, "edit", 0.75))


@query
def plan_cosine(spark: SparkSession, sf: str) -> DataFrame:
    tags = v.base(spark, sf).tags
    vectors = v.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector")
    )
    known = vectors.join(tags.select("id"), "id", "left_semi")
    return _star_columns(mp.plan_by_similarity(tags, "cosine", COSINE, vectors=known))


@query
def plan_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    base = v.base(spark, sf)
    groups = mp.plan_by_similarity(base.tags, "jaccard", JACCARD, pairs=v.junction(base))
    return _star_columns(groups)


# -- streaming ----------------------------------------------------------------------
@query
def classify_errors(spark: SparkSession, sf: str) -> DataFrame:
    verdict = classify_error(F.col("error"), F.col("attempts"))
    failed = v.messages(spark, sf).where("failed").select("event_id", verdict.alias("c"))
    return failed.select("event_id", "c.kind", "c.action", "c.delay_seconds")


@query
def backoff(spark: SparkSession, sf: str) -> DataFrame:
    return v.messages(spark, sf).select(
        "event_id", backoff_seconds(F.col("attempts")).alias("delay_seconds")
    )


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return route(v.messages(spark, sf), F.col("timestamp"))


@query
def retry_routing(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("event_id", "action", "delay_seconds", "next_at")


@query
def dead_letter_messages(spark: SparkSession, sf: str) -> DataFrame:
    return dead_letters(_routed(spark, sf)).select(
        "event_id", "snippet_id", "error", big("attempts").alias("attempts")
    )


@query
def due_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Retries that came due by the end of the first day of 2024."""
    due = retry_messages(_routed(spark, sf), 0, 1704153600000)
    return due.groupBy("snippet_id", "timestamp", "attempts").agg(
        F.count("*").alias("n_messages")
    ).withColumn("attempts", big("attempts"))


# Two rounds of queueing, and the time that is enough for any retry to come due.
ROUNDS = (1704067200000, 1706745600000)
LONG_AFTER = 10_000_000


@query
def queue_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Every snippet of the events queued twice: how each round of it ended.

    A snippet fails with the error of its first failed event, in every delivery.
    """
    messages = v.messages(spark, sf)
    first = F.min_by("error", "event_id").alias("error")
    failing = messages.where("failed").groupBy("snippet_id").agg(first)
    snippets = materialize(
        messages.select("snippet_id").distinct()
        .join(failing.withColumn("failed", F.lit(True)), "snippet_id", "left")
        .withColumn("failed", F.coalesce("failed", F.lit(False))),
        "snippets",
    )
    queue = Queue(spark, *(scratch_path(spark, name) for name in ("queue", "results", "dead")))
    batch_id = 0
    for queued_at in ROUNDS:
        enqueue(snippets.select(F.col("snippet_id").alias("id")), queue.messages, queued_at)
        now = queued_at
        while True:
            waiting = queue.delivered().where(F.col("timestamp") == now)
            tried = waiting.join(snippets, "snippet_id").withColumn("queued_at", F.lit(now))
            write_outcomes(route(tried, now), queue.results, batch_id)
            batch_id, now = batch_id + 1, now + LONG_AFTER
            if not queue.feed_retries(now):
                break
        queue.settle()
    queue.check_idle()
    dead = queue.read_dead_letters().select("snippet_id", "run", F.lit(True).alias("dead"))
    last = queue.outcomes().groupBy("snippet_id", "run").agg(big(F.max("attempts")).alias("attempts"))
    return last.join(dead, ["snippet_id", "run"], "left").select(
        "snippet_id", "run", "attempts", F.coalesce("dead", F.lit(False)).alias("dead")
    )


@query
def queue_progress(spark: SparkSession, sf: str) -> DataFrame:
    chunked = paging.assign_chunks(backlog(v.snippets(spark, sf)).select("id"))
    tried = _queue_outcomes(spark, sf)
    return progress(chunked, tried).drop("error_message", "started_at")


@query
def requeue_backlog(spark: SparkSession, sf: str) -> DataFrame:
    in_flight = v.messages(spark, sf).where(~F.col("failed")).select("snippet_id")
    return backlog(v.snippets(spark, sf), in_flight, CURSOR).select("id")


@query
def stream_tagging(spark: SparkSession, sf: str) -> DataFrame:
    """Messages for all events tagged by the stream and folded into the tables."""
    store = _store(spark, "stream")
    store.publish({"snippets": v.snippets(spark, sf), "tags": v.vocabulary(spark, sf)})
    queue = scratch_path(spark, "queue")
    v.messages(spark, sf).select(
        "snippet_id", "timestamp", "priority", "attempts"
    ).write.parquet(queue)
    sink = scratch_path(spark, "results")
    start_tagging_stream(
        read_messages(spark, queue), store, v.docs(spark, sf), terms_proposer(WORD),
        sink, scratch_path(spark, "marks"), Settings(WORD, max_tags=ROOM),
    ).awaitTermination()
    fold_stream(store, sink)
    tables = store.snapshot()
    pairs = tables.snippet_tags
    tags = tables.tags.select(F.col("id").alias("tag_id"), "name")
    return pairs.join(tags, "tag_id").select("snippet_id", "tag_id", "name")


# -- maintenance --------------------------------------------------------------------
@query
def clear_all_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Counts before clearing next to what is left afterwards."""
    store = _filled_store(spark, sf, "clear")
    before = maintenance.clear_tags(store, confirm=True)
    left = maintenance.status(store)
    return before.select(
        F.lit("before").alias("moment"), "total_tags", "tagged_snippets", "total_snippets"
    ).unionByName(left.select(
        F.lit("after").alias("moment"), "total_tags", "tagged_snippets", "total_snippets"
    ))
