"""Whole jobs over a table store: batches, consolidation, clearing, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.config import WORD
from tagloom.operators.integrity import integrity_report
from tagloom.operators.matching import exact_match
from tagloom.operators.merge_plans import edit_pairs
from tagloom.operators.propose import Facet, propose_with_lexicon
from tagloom.operators.vocabulary import assign_tags, grow_vocabulary
from tagloom.plans import maintenance
from tagloom.plans.tagging import Settings, model_proposer, tag_batch
from tagloom.sources import content as cont
from tagloom.sources.messages import as_messages, enqueue, read_messages
from tagloom.sources.schemas import SNIPPETS
from tagloom.sources.tables import TableStore
from tagloom.streaming.loop import Queue
from tagloom.streaming.progress import backlog, progress
from tagloom.streaming.tagging import (
    fold_stream,
    read_results,
    run_batch,
    start_tagging_stream,
)

TEXTS = {
    "s01": "apple banana", "s02": "banana cherry", "s03": "apples banane",
    "s04": "FAIL 503", "s05": "cherry", "s06": "none here:", "s07": None,
}
SETTINGS = Settings(WORD)
FACETS = [Facet(0, "a|"), Facet(1, "b|")]


def make_proposer():
    """A model that replies with the words of the text, one per line."""

    def loader():
        def reply(prompts):
            if any("FAIL" in p for p in prompts):
                raise RuntimeError("upstream answered 503")
            return ["\n".join(p.split("|")[1].split()) for p in prompts]

        return reply

    return model_proposer(FACETS, loader, WORD)


@pytest.fixture
def store(spark, tmp_path):
    made = TableStore(spark, str(tmp_path / "tables"))
    rows = [(i, "t", "a", 1, "u", None, None) for i in sorted(TEXTS)]
    now = F.lit("2024-01-01").cast("timestamp")
    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in SNIPPETS
    )
    snippets = spark.createDataFrame(rows, schema).withColumn("created_at", now)
    made.publish({"snippets": snippets})
    return made


@pytest.fixture
def content(spark):
    rows = [(i, t) for i, t in TEXTS.items() if t is not None]
    return spark.createDataFrame(rows, "id string, text string")


def lists_of(store):
    return {r["id"]: r["tags"] for r in store.read_snippets().collect()}


def tags_of(store):
    return {r["name"]: (r["id"], r["usage_count"]) for r in store.read_tags().collect()}


def pairs_of(store):
    return sorted(tuple(r) for r in store.read_snippet_tags().collect())


EXPECTED_LISTS = {
    "s01": "[1,2]", "s02": "[2,3]", "s03": "[1,2]", "s04": None,
    "s05": "[3]", "s06": "[]", "s07": None,
}


def test_pages_follow_the_cursor_even_past_errors(store, content):
    first = tag_batch(store, content, make_proposer(), SETTINGS, batch_size=4)
    stats = first.stats.first().asDict()
    assert stats == {
        "processed_snippets": 3, "new_tags_created": 3, "existing_tags_used": 3,
        "n_errors": 1, "last_processed_id": "s04", "total_tags": 3,
    }
    assert [r["error"] for r in first.errors.collect()] == ["Snippet s04: upstream answered 503"]
    assert first.next_cursor == "s04"
    second = tag_batch(store, content, make_proposer(), SETTINGS, batch_size=4, start_from="s04")
    assert second.next_cursor == "s07"
    assert [r["error"] for r in second.errors.collect()] == [
        "Snippet s07: Content for snippet s07 not found in content store"]
    assert lists_of(store) == EXPECTED_LISTS
    assert tags_of(store) == {"apple": (1, 2), "banana": (2, 3), "cherry": (3, 2)}
    last = tag_batch(store, content, make_proposer(), SETTINGS, batch_size=4, start_from="s07")
    assert last.next_cursor is None
    assert last.stats.first()["processed_snippets"] == 0


def test_one_snippet(store, content):
    done = tag_batch(store, content, make_proposer(), SETTINGS, snippet_id="s05")
    stats = done.stats.first()
    assert (stats["processed_snippets"], stats["last_processed_id"]) == (0, None)
    assert (stats["new_tags_created"], done.next_cursor) == (1, None)
    assert lists_of(store)["s05"] == "[1]"
    with pytest.raises(LookupError, match="Snippet zzz not found"):
        tag_batch(store, content, make_proposer(), SETTINGS, snippet_id="zzz")


def test_tagging_again_keeps_lists_and_pairs_and_counts_again(store, content):
    for _ in range(2):
        tag_batch(store, content, make_proposer(), SETTINGS, snippet_id="s01")
    assert lists_of(store)["s01"] == "[1,2]"
    assert pairs_of(store) == [("s01", 1), ("s01", 2)]
    assert tags_of(store) == {"apple": (1, 2), "banana": (2, 2)}


def test_consolidating_and_clearing(store, content, spark):
    tag_batch(store, content, make_proposer(), SETTINGS, batch_size=None)
    before = lists_of(store), tags_of(store), pairs_of(store)
    plan = {"consolidations": [{
        "primary_tag_id": 3, "primary_tag_name": "fruits", "merge_tag_ids": [2], "reason": ""}]}
    replies = spark.createDataFrame([(1, json.dumps(plan))], "reply_no bigint, reply string")
    dry = maintenance.consolidate(store, replies, profile=WORD, dry_run=True)
    assert not dry.applied and dry.report.first()["snippets_updated"] == 3
    assert (lists_of(store), tags_of(store), pairs_of(store)) == before
    maintenance.consolidate(store, replies, profile=WORD)
    assert lists_of(store) == {
        **EXPECTED_LISTS, "s01": "[1,3]", "s02": "[3]", "s03": "[1,3]"}
    assert tags_of(store) == {"apple": (1, 2), "fruits": (3, 5)}
    assert pairs_of(store) == [
        ("s01", 1), ("s01", 3), ("s02", 3), ("s03", 1), ("s03", 3), ("s05", 3)]
    with pytest.raises(ValueError):
        maintenance.clear_tags(store)
    removed = maintenance.clear_tags(store, confirm=True).first().asDict()
    assert removed == {"total_tags": 2, "tagged_snippets": 4, "total_snippets": 7}
    assert set(lists_of(store).values()) == {None} and pairs_of(store) == []
    tag_batch(store, content, make_proposer(), SETTINGS, snippet_id="s05")
    assert tags_of(store) == {"cherry": (4, 1)}  # ids are never given out twice


def test_snapshots_do_not_move(store, content):
    old = store.snapshot()
    tag_batch(store, content, make_proposer(), SETTINGS, snippet_id="s05")
    assert old.tags.isEmpty() and store.snapshot().version == old.version + 1


def test_keyed_content_reads_only_the_folders_asked_for(spark, content, tmp_path):
    path = str(tmp_path / "content")
    cont.write_content(content, path, buckets=64, files_per_bucket=2)
    keyed = cont.read_keyed_content(spark, path, buckets=64)
    ids = spark.createDataFrame([("s02",)], "id string")
    found = cont.content_of(keyed, ids)
    assert {r["id"]: r["text"] for r in found.collect()}["s02"] == TEXTS["s02"]
    assert found.count() < keyed.table.count()


def test_content_files(spark, tmp_path):
    (tmp_path / "s01").write_text("Grüße\n", encoding="utf-8")
    rows = cont.read_content_files(spark, str(tmp_path)).collect()
    assert [(r["id"], r["text"]) for r in rows] == [("s01", "Grüße\n")]


def stream(store, content, queue, tmp_path, per_trigger):
    messages = read_messages(store.spark, queue, maxFilesPerTrigger=str(per_trigger))
    query = start_tagging_stream(
        messages, store, content, make_proposer(), str(tmp_path / "sink"),
        str(tmp_path / "marks"), SETTINGS)
    query.awaitTermination()
    return str(tmp_path / "sink")


@pytest.mark.parametrize("per_trigger", [100, 1])
def test_stream_equals_batch_however_it_is_cut(store, content, tmp_path, per_trigger):
    queue = str(tmp_path / "queue")
    waiting = backlog(store.read_snippets())
    enqueue(waiting.where("id < 's03'").coalesce(1), queue, 1000)
    enqueue(waiting.where("id >= 's03'").coalesce(1), queue, 1000)
    enqueue(waiting.coalesce(1), queue, 2000)  # everything is delivered twice
    sink = stream(store, content, queue, tmp_path, per_trigger)
    assert fold_stream(store, sink)
    assert lists_of(store) == EXPECTED_LISTS
    assert {n: i for n, (i, _) in tags_of(store).items()} == {"apple": 1, "banana": 2, "cherry": 3}
    assert not fold_stream(store, sink)
    outcomes = read_results(store.spark, sink, "outcomes").where("failed")
    assert {(r["snippet_id"], r["action"]) for r in outcomes.collect()} == {
        ("s04", "retry"), ("s07", "ack")}
    # a restart goes on behind the checkpoint
    enqueue(waiting.where("id = 's05'"), queue, 3000)
    before = read_results(store.spark, sink, "outcomes").count()
    stream(store, content, queue, tmp_path, per_trigger)
    assert read_results(store.spark, sink, "outcomes").count() == before + 1
    assert fold_stream(store, sink) and lists_of(store) == EXPECTED_LISTS


def test_a_replayed_batch_changes_nothing(store, content, tmp_path):
    sink = str(tmp_path / "sink")
    messages = as_messages(backlog(store.read_snippets()), 1)
    for batch_id in (0, 1, 1):
        run_batch(messages, batch_id, store, content, make_proposer(), sink, SETTINGS, now_ms=5)
    assert fold_stream(store, sink)
    assert tags_of(store) == {"apple": (1, 4), "banana": (2, 6), "cherry": (3, 4)}
    assert lists_of(store) == EXPECTED_LISTS


@pytest.mark.parametrize("tried, state", [
    ([], ("processing", 0, 0, 0, 1, None)),
    ([("a", True), ("b", False)], ("processing", 1, 1, 1, 2, "a")),
    ([("a", True), ("b", False), ("c", True)], ("completed", 2, 1, 2, 3, "c")),
])
def test_progress(spark, tried, state):
    chunked = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, chunk bigint")
    row = progress(chunked, spark.createDataFrame(tried, "id string, ok boolean"), 2).first()
    assert (row["status"], row["queued"], row["failed"], row["processed_chunks"],
            row["current_chunk"], row["resume_from_id"]) == state
    assert (row["total"], row["total_chunks"]) == (3, 2)


def test_nothing_to_queue_is_completed(spark):
    chunked = spark.createDataFrame([], "id string, chunk bigint")
    row = progress(chunked, spark.createDataFrame([], "id string, ok boolean")).first()
    assert (row["status"], row["total"], row["total_chunks"], row["current_chunk"]) == (
        "completed", 0, 0, 0)


def one_batch(store, content, ids, batch_id, sink):
    waiting = store.read_snippets().where(F.col("id").isin(ids))
    run_batch(as_messages(waiting, 1), batch_id, store, content, make_proposer(), sink,
              SETTINGS, now_ms=5)


def assert_sound(store):
    now = store.snapshot()
    report = integrity_report(now.snippets, now.tags, now.snippet_tags)
    assert {r["n_rows"] for r in report.collect()} == {0}
    lists = {i: set(json.loads(t)) for i, t in lists_of(store).items() if t}
    known = {i for i, _ in tags_of(store).values()}
    assert set().union(*lists.values()) <= known
    assert {(i, t) for i, ts in lists.items() for t in ts} == set(pairs_of(store))


def test_a_batch_between_stream_and_fold(store, content, tmp_path):
    sink = str(tmp_path / "sink")
    one_batch(store, content, ["s01"], 0, sink)       # apple, banana
    tag_batch(store, content, make_proposer(), SETTINGS, snippet_id="s02")  # banana, cherry
    assert fold_stream(store, sink)
    assert_sound(store)
    ids = {n: i for n, (i, _) in tags_of(store).items()}
    assert set(ids) == {"apple", "banana", "cherry"} and len(set(ids.values())) == 3
    assert json.loads(lists_of(store)["s01"]) == [ids["apple"], ids["banana"]]
    assert json.loads(lists_of(store)["s02"]) == [ids["banana"], ids["cherry"]]


def test_a_consolidation_between_stream_and_fold(store, content, tmp_path, spark):
    sink = str(tmp_path / "sink")
    tag_batch(store, content, make_proposer(), SETTINGS, snippet_id="s02")  # banana 1, cherry 2
    one_batch(store, content, ["s01", "s05"], 0, sink)
    plan = {"consolidations": [{
        "primary_tag_id": 2, "primary_tag_name": None, "merge_tag_ids": [1], "reason": ""}]}
    replies = spark.createDataFrame([(1, json.dumps(plan))], "reply_no bigint, reply string")
    maintenance.consolidate(store, replies, profile=WORD)
    assert fold_stream(store, sink)
    assert_sound(store)
    assert json.loads(lists_of(store)["s01"])[1] == 2


def test_a_clear_between_stream_and_fold(store, content, tmp_path):
    sink = str(tmp_path / "sink")
    one_batch(store, content, ["s01"], 0, sink)
    maintenance.clear_tags(store, confirm=True)
    assert fold_stream(store, sink)
    assert_sound(store)
    assert tags_of(store) == {} and lists_of(store)["s01"] is None
    one_batch(store, content, ["s05"], 1, sink)
    assert fold_stream(store, sink)
    assert_sound(store)
    assert list(tags_of(store)) == ["cherry"] and tags_of(store)["cherry"][0] > 2


def test_a_new_checkpoint_on_an_old_sink_is_refused(store, content, tmp_path):
    sink = str(tmp_path / "sink")
    for batch_id in (0, 1):
        one_batch(store, content, ["s01"], batch_id, sink)
    with pytest.raises(ValueError, match="new sink"):
        one_batch(store, content, ["s02"], 0, sink)


def test_a_failed_facet_keeps_the_others(spark):
    def loader():
        def reply(prompts):
            if any(p.startswith("b|") for p in prompts):
                raise RuntimeError("upstream answered 503")
            return ["\n".join(p.split("|")[1].split()) for p in prompts]

        return reply

    docs = spark.createDataFrame([("x", "apple banana")], "id string, text string")
    row = model_proposer(FACETS, loader, WORD)(docs).first()
    assert (row["names"], row["error"], row["failed"]) == (
        ["apple", "banana"], "upstream answered 503", False)


def test_tags_that_differ_in_case_only(spark):
    tags = spark.createDataFrame([(2, "kitchen"), (1, "Kitchen")], "id bigint, name string")
    names = spark.createDataFrame([("a", 1, "KITCHEN")], "id string, idx int, name string")
    given = assign_tags(names, tags).collect()
    assert [(r["tag_id"], r["is_new"]) for r in given] == [(1, False)]
    assert [r["tag_id"] for r in exact_match(names, tags).collect()] == [1]
    assert grow_vocabulary(names, tags).isEmpty()
    pairs = [(r["a"], r["b"], r["similarity"]) for r in edit_pairs(tags).collect()]
    assert pairs == [(1, 2, 1.0)]


def test_short_profiles_still_match_long_names(spark):
    names = spark.createDataFrame(
        [("a", 1, "kitchen"), ("b", 1, "kitchens")], "id string, idx int, name string")
    none = spark.createDataFrame([], "id bigint, name string")
    assert [r["name"] for r in grow_vocabulary(names, none).collect()] == ["kitchen"]


def test_repeated_lexicon_rows_count_once(spark):
    docs = spark.createDataFrame(
        [("x", "delta alpha alpha bravo bravo bravo")], "id string, text string")
    rows = [("bravo", 0), ("alpha", 0), ("delta", 0)]
    for lexicon in (rows, rows + [("delta", 0)] * 3):
        frame = spark.createDataFrame(lexicon, "term string, facet int")
        plan = propose_with_lexicon(docs, frame, [0])
        assert plan.first()["names"] == ["bravo", "alpha", "delta"]


def test_the_queue_loop_ends_every_message(store, content, tmp_path, spark):
    queue = Queue(spark, *(str(tmp_path / n) for n in ("queue", "sink", "dead")))
    assert queue.state().first()["status"] == "idle"
    waiting = backlog(store.read_snippets())
    enqueue(waiting.where("id in ('s01', 's04', 's07')"), queue.messages, 1000)
    with pytest.raises(RuntimeError, match="3 snippets"):
        queue.check_idle()
    now = 0
    for delivery in range(1, 5):
        messages = queue.delivered().where(F.col("attempts") == delivery)
        run_batch(messages, delivery, store, content, make_proposer(), queue.results,
                  SETTINGS, now_ms=now)
        now += 10_000_000
        assert queue.feed_retries(now) == (1 if delivery < 4 else 0)
        assert queue.feed_retries(now) == 0
    queue.check_idle()
    queue.write_dead_letters()
    dead = [(r["snippet_id"], r["attempts"]) for r in queue.read_dead_letters().collect()]
    assert dead == [("s04", 4)]
    row = queue.state().first()
    assert (row["status"], row["in_flight"], row["dead_letters"]) == ("completed", 0, 1)
    assert backlog(store.read_snippets(), queue.in_flight()).count() == 7
