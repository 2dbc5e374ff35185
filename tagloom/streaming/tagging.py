"""Tagging from a message stream, micro-batch by micro-batch.

A batch appends what it found below ``sink``, in folders named by its batch id,
and rewrites exactly those folders when it is replayed. So delivery may repeat,
while lists, junction and counters come out once. ``fold_stream`` brings the
appended results into the tables in one publish; the stream never rewrites them.

Other jobs may run between a micro-batch and its folding. A batch reserves the ids
of its new tags in the manifest, so no other job gives them out. Folding looks up
every tag again: one that another job made meanwhile under the same name wins, a
merged tag stands for what it merged into, and batches from before a clear are void.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.config import MAX_RETRIES
from tagloom.operators.reports import usage_increments
from tagloom.plans.tagging import (
    Proposer,
    Settings,
    changed_tables,
    stored_tags,
    tag_snippets,
)
from tagloom.session import materialize
from tagloom.sources.content import Content
from tagloom.sources.messages import delivery_key
from tagloom.sources.tables import Snapshot, TableStore
from tagloom.streaming.routing import route

KINDS = {
    "new_tags": "tag_id bigint, name string, key string, born_id string, born_idx int",
    "assignments": "id string, idx int, tag_id bigint, is_new boolean",
    "outcomes": (
        "snippet_id string, run bigint, attempts int, error string, failed boolean, "
        "kind string, action string, delay_seconds bigint, next_at bigint, "
        "version bigint, queued_at bigint"
    ),
}


def read_results(spark: SparkSession, sink: str, kind: str) -> DataFrame:
    """Appended rows of one kind with their ``batch_id``."""
    schema = f"{KINDS[kind]}, batch_id bigint"
    try:
        return spark.read.schema(schema).parquet(f"{sink}/{kind}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, sink: str, kind: str, batch_id: int) -> None:
    columns = [name.split()[0] for name in KINDS[kind].split(", ")]
    path = f"{sink}/{kind}/batch_id={batch_id}"
    df.select(*columns).write.mode("overwrite").parquet(path)


def write_outcomes(routed: DataFrame, sink: str, batch_id: int) -> None:
    """What became of a batch's deliveries; written last, it finishes the batch."""
    if "version" not in routed.columns:
        routed = routed.withColumn("version", F.lit(0).cast("bigint"))
    _write(routed, sink, "outcomes", batch_id)


def start_tagging_stream(
    messages: DataFrame,
    store: TableStore,
    content: Content,
    proposer: Proposer,
    sink: str,
    checkpoint: str,
    settings: Settings = Settings(),
    max_retries: int = MAX_RETRIES,
    available_now: bool = True,
) -> StreamingQuery:
    """Tag the snippets of every message; use ``query.stop()`` to stop.

    ``sink`` and ``checkpoint`` are folders all executors share.
    """
    store.init_tables()

    def run(batch: DataFrame, batch_id: int) -> None:
        run_batch(
            batch, batch_id, store, content, proposer, sink, settings, max_retries
        )

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_batch(
    batch: DataFrame,
    batch_id: int,
    store: TableStore,
    content: Content,
    proposer: Proposer,
    sink: str,
    settings: Settings,
    max_retries: int = MAX_RETRIES,
    now_ms: int | None = None,
) -> None:
    """One micro-batch. The vocabulary grows once for all of its snippets."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    newest = read_results(store.spark, sink, "outcomes").agg(F.max("batch_id")).first()[0]
    if newest is not None and newest > batch_id:
        raise ValueError(
            f"{sink} holds batch {newest}, behind batch {batch_id}: "
            "a new checkpoint needs a new sink"
        )
    # one row per delivery: repeats in the queue are combined map-side
    wanted = materialize(
        batch.groupBy(*delivery_key()).agg(F.max("timestamp").alias("queued_at")), "wanted"
    )
    tables = store.snapshot()
    before = _unfolded(tables, sink, "new_tags").where(F.col("batch_id") < batch_id)
    grown = before.select(F.col("tag_id").alias("id"), "name")
    vocabulary = tables.tags.select("id", "name").unionByName(grown)
    top = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    tagged = tag_snippets(
        wanted.select(F.col("snippet_id").alias("id")), tables.snippets, content,
        vocabulary, proposer, settings, max(top, tables.high_water),
    )
    outcomes = tagged.outcomes.select(
        F.col("id").alias("snippet_id"), "error", F.col("error").isNotNull().alias("failed")
    )
    routed = route(wanted.join(outcomes, "snippet_id"), now, max_retries).withColumn(
        "version", F.lit(tables.version).cast("bigint")
    )
    given = tagged.new_tags.agg(F.max("tag_id")).first()[0]
    if given is not None:
        store.publish({}, high_water=given)
    _write(tagged.new_tags, sink, "new_tags", batch_id)
    _write(tagged.assignments, sink, "assignments", batch_id)
    write_outcomes(routed, sink, batch_id)


def _unfolded(tables: Snapshot, sink: str, kind: str) -> DataFrame:
    rows = read_results(tables.spark, sink, kind)
    return rows.where(F.col("batch_id") > tables.folded.get(sink, -1))


def latest_assignments(
    outcomes: DataFrame, assignments: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Processed ids and the assignments of their latest successful batch."""
    done = (
        outcomes.where(~F.col("failed"))
        .groupBy(F.col("snippet_id").alias("id")).agg(F.max("batch_id").alias("batch_id"))
    )
    return done.select("id"), assignments.join(done, ["id", "batch_id"])


def final_tags(found: DataFrame, tags: DataFrame, merges: DataFrame) -> DataFrame:
    """``tag_id, final_id``: the tag that each id a stream used stands for now.

    ``found`` are the stream's new tags, ``tags`` the stored ones, ``merges`` a forest
    in which every merged tag names what it stands for now. Ids that no tag stands for
    any more have no row; each other id has one.
    """
    stored = tags.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("stored_id"))
    first = found.groupBy("key").agg(F.min("tag_id").alias("first_id"))
    new = found.join(stored, "key", "left").join(first, "key").select(
        "tag_id", F.coalesce("stored_id", "first_id").alias("final_id")
    )
    known = tags.select(F.col("id").alias("tag_id"), F.col("id").alias("final_id"))
    merged = merges.select(
        F.col("merge_id").alias("tag_id"), F.col("primary_id").alias("final_id")
    ).join(tags.select(F.col("id").alias("final_id")), "final_id", "left_semi").select(
        "tag_id", "final_id"
    )
    return new.unionByName(known).unionByName(merged)


def fold_stream(store: TableStore, sink: str) -> bool:
    """Bring finished batches into the tables; True if there were any.

    Run it while the stream is stopped. The manifest notes the newest batch
    folded in per sink, so that folding again adds nothing. A batch is finished
    once its outcomes are there, since they are written last. Every batch counts
    towards the usage counters, as each run does; lists and junction show the
    latest. Batches found before the last clear are passed over.
    """
    before = store.snapshot()
    outcomes = _unfolded(before, sink, "outcomes")
    newest = outcomes.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return False
    void = outcomes.where(F.col("version") < before.cleared).select("batch_id").distinct()
    outcomes = outcomes.join(void, "batch_id", "left_anti")
    finished = F.col("batch_id") <= newest

    def valid(kind: str) -> DataFrame:
        rows = _unfolded(before, sink, kind).where(finished)
        return rows.join(void, "batch_id", "left_anti")

    found = valid("new_tags")
    final = materialize(final_tags(found, before.tags, before.merges), "final-tags")
    assignments = valid("assignments").join(final, "tag_id").withColumn(
        "tag_id", F.col("final_id")
    ).drop("final_id")
    new_tags = found.join(
        final.where(F.col("tag_id") == F.col("final_id")).select("tag_id"), "tag_id", "left_semi"
    )
    processed, latest = latest_assignments(outcomes, assignments)
    change = changed_tables(
        before, processed, latest, stored_tags(new_tags), usage_increments(assignments)
    )
    store.publish(
        change.frames, high_water=found.agg(F.max("tag_id")).first()[0],
        folded={sink: newest}, touched=change.touched,
    )
    return True
