"""Tagging snippets: one page, one snippet or the whole backlog."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.config import (
    BATCH_SIZE,
    CJK2,
    LINES_PER_REPLY,
    MAX_TAGS,
    MAX_TEXT_CHARS,
    SIMILARITY_THRESHOLD,
    Profile,
)
from tagloom.functions.predicates import after, is_untagged, snippet_by_id
from tagloom.operators.keyed import (
    fresh_rows,
    replace_pairs,
    snippet_arrays,
    update_tags_column,
)
from tagloom.operators.paging import next_page
from tagloom.operators.propose import (
    Facet,
    Reply,
    explode_names,
    facet_prompts,
    proposals_from_replies,
    propose_with_lexicon,
    propose_with_model,
    top_terms,
)
from tagloom.operators.reports import apply_usage, run_errors, run_stats, usage_increments
from tagloom.operators.vocabulary import assign_tags, grow_vocabulary
from tagloom.session import materialize
from tagloom.sources.content import Content, content_of, missing_content
from tagloom.sources.tables import Snapshot, TableStore

# From documents (id, text) to proposals: id, names and optionally error and failed
# (no names at all; without it every error counts as that).
Proposer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    profile: Profile = CJK2
    theta: float = SIMILARITY_THRESHOLD
    max_tags: int = MAX_TAGS


def lexicon_proposer(
    lexicon: DataFrame, facet_numbers: Sequence[int], per_facet: int = LINES_PER_REPLY
) -> Proposer:
    return lambda docs: propose_with_lexicon(docs, lexicon, facet_numbers, per_facet)


def terms_proposer(profile: Profile, n: int = LINES_PER_REPLY) -> Proposer:
    return lambda docs: top_terms(docs, profile, n)


def model_proposer(
    facets: Sequence[Facet],
    load: Callable[[], Reply],
    profile: Profile,
    limit: int = MAX_TEXT_CHARS,
) -> Proposer:
    numbers = [f.number for f in facets]

    def propose(documents: DataFrame) -> DataFrame:
        replies = propose_with_model(facet_prompts(documents, facets, limit), load)
        return proposals_from_replies(replies, numbers, profile)

    return propose


@dataclass(frozen=True)
class Tagged:
    """What tagging a set of snippets comes to, before anything is stored."""

    processed: DataFrame     # id
    assignments: DataFrame   # id, idx, name, tag_id, similarity, is_new
    new_tags: DataFrame      # tag_id, name, key, born_id, born_idx
    outcomes: DataFrame      # id, error, new_tags, existing_tags


def tag_snippets(
    ids: DataFrame,
    snippets: DataFrame,
    content: Content,
    vocabulary: DataFrame,
    proposer: Proposer,
    settings: Settings,
    high_water: int,
) -> Tagged:
    """Propose, grow the vocabulary once, assign, and note what went wrong.

    Proposals and assignments are written to the shared scratch folder: a model
    is never asked twice, and an executor lost later costs no re-tagging.
    """
    ids = materialize(ids.select("id").distinct(), "ids")
    stored = content_of(content, ids)
    missing = materialize(
        missing_content(ids, snippets, stored).select("id", "message"), "missing"
    )
    # the ids have a known size: few of them are broadcast to the content scan
    found = ids.join(missing.select("id"), "id", "left_anti")
    texts = stored.join(found, "id", "left_semi")
    proposed = proposer(texts)
    if "error" not in proposed.columns:
        proposed = proposed.withColumn("error", F.lit(None).cast("string"))
    if "failed" not in proposed.columns:
        proposed = proposed.withColumn("failed", F.col("error").isNotNull())
    # what some facets answered counts, whatever error another facet left
    proposed = materialize(proposed.select("id", "names", "error", "failed"), "proposals")
    failed = proposed.where("failed").select("id", F.col("error").alias("message"))
    errors = missing.unionByName(failed).withColumnRenamed("message", "error")
    names = explode_names(proposed.where(~F.col("failed")))
    new_tags = grow_vocabulary(
        names, vocabulary, settings.theta, settings.max_tags, high_water
    )
    assignments = materialize(
        assign_tags(names, vocabulary, new_tags, settings.theta),
        "assignments",
    )
    uses = assignments.groupBy("id").agg(
        F.count_if("is_new").alias("new_tags"),
        F.count_if(~F.col("is_new")).alias("existing_tags"),
    )
    outcomes = materialize(
        ids.join(errors, "id", "left").join(uses, "id", "left").select(
            "id", "error",
            F.coalesce("new_tags", F.lit(0)).alias("new_tags"),
            F.coalesce("existing_tags", F.lit(0)).alias("existing_tags"),
        ),
        "outcomes",
    )
    processed = outcomes.where(F.col("error").isNull()).select("id")
    return Tagged(processed, assignments, new_tags, outcomes)


def stored_tags(new_tags: DataFrame) -> DataFrame:
    """New tags as rows of the tags table."""
    return new_tags.select(
        F.col("tag_id").alias("id"),
        "name",
        F.current_timestamp().alias("created_at"),
        F.lit(0).cast("bigint").alias("usage_count"),
    )


@dataclass(frozen=True)
class Change:
    """New rows of the buckets of each table that a run touches."""

    frames: dict[str, DataFrame]
    touched: dict[str, set[int]]


def changed_tables(
    before: Snapshot,
    processed: DataFrame,
    assignments: DataFrame,
    new_rows: DataFrame,
    increments: DataFrame,
) -> Change:
    """Lists, junction, counters and new tags after a run.

    Only buckets that hold a processed snippet, a counted or a new tag are read and
    written.
    """
    fresh = materialize(fresh_rows(before.tags, new_rows, ["name"]), "fresh-tags")
    increments = materialize(increments, "increments")
    counted = increments.select("tag_id").unionByName(fresh.select(F.col("id").alias("tag_id")))
    ids = processed.select("id")
    touched = {
        "snippets": before.touched("snippets", ids),
        "tags": before.touched("tags", counted),
        "snippet_tags": before.touched("snippet_tags", ids),
    }
    snippets, tags, pairs = (before.read(name, touched[name]) for name in touched)
    return Change({
        "snippets": update_tags_column(snippets, snippet_arrays(processed, assignments)),
        "tags": apply_usage(tags.unionByName(fresh), increments),
        "snippet_tags": replace_pairs(pairs, processed, assignments),
    }, touched)


@dataclass(frozen=True)
class BatchResult:
    stats: DataFrame         # one row
    errors: DataFrame        # id, error
    next_cursor: str | None  # where the next page starts


def tag_batch(
    store: TableStore,
    content: Content,
    proposer: Proposer,
    settings: Settings = Settings(),
    snippet_id: str | None = None,
    batch_size: int | None = BATCH_SIZE,
    start_from: str | None = None,
) -> BatchResult:
    """Tag one snippet, the next page, or with ``batch_size=None`` everything.

    Tables are rewritten by the buckets that hold something new, so a page costs its
    own buckets and a whole backlog every bucket once. A single snippet counts as no
    page: it leaves ``processed_snippets`` at 0, and its error is raised.
    """
    before = store.init_tables()
    snippets, tags = before.snippets, before.tags
    if snippet_id is not None:
        spark = store.spark
        ids = spark.createDataFrame([(snippet_id,)], "id string")
        snippets_of_run = snippet_by_id(snippets, snippet_id)
    elif batch_size is None:
        ids = after(snippets.where(is_untagged(F.col("tags"))), start_from).select("id")
        snippets_of_run = snippets
    else:
        ids = next_page(snippets, batch_size, start_from).select("id")
        snippets_of_run = snippets
    tagged = tag_snippets(
        ids, snippets_of_run, content, tags, proposer, settings, before.high_water
    )
    outcomes = tagged.outcomes
    if snippet_id is not None:
        error = outcomes.select("error").first()["error"]
        if error is not None:
            raise LookupError(error)
    top = tagged.new_tags.agg(F.max("tag_id")).first()[0]
    change = changed_tables(
        before, tagged.processed, tagged.assignments, stored_tags(tagged.new_tags),
        usage_increments(tagged.assignments),
    )
    after_run = store.publish(change.frames, high_water=top, touched=change.touched)
    stats = run_stats(outcomes, after_run.tags.count())
    cursor = None
    if snippet_id is not None:
        stats = stats.withColumn("processed_snippets", F.lit(0).cast("bigint"))
        stats = stats.withColumn("last_processed_id", F.lit(None).cast("string"))
    else:
        cursor = outcomes.agg(F.max("id")).first()[0]
    return BatchResult(stats, run_errors(outcomes), cursor)
