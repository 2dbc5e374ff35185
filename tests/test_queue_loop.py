"""Rounds of queueing: retries, dead letters, settlement, bounded batches, archive."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagloom.sources.messages import as_messages, enqueue, read_messages
from tagloom.streaming.loop import Queue
from tagloom.streaming.routing import route
from tagloom.streaming.tagging import write_outcomes

LATER = 10_000_000
BAD = {"b": "upstream answered 503", "c": "Snippet c not found"}


@pytest.fixture
def queue(spark, tmp_path):
    return Queue(spark, *(str(tmp_path / n) for n in ("queue", "sink", "dead")))


class Consumer:
    """Delivers what was queued at a time; ``b`` always fails, ``c`` is missing."""

    def __init__(self, queue):
        self.queue, self.batch_id = queue, 0

    def take(self, at):
        errors = [(i, BAD[i]) for i in BAD]
        errors = self.queue.spark.createDataFrame(errors, "snippet_id string, error string")
        tried = (
            self.queue.delivered().where(F.col("timestamp") == at)
            .join(errors, "snippet_id", "left")
            .withColumn("failed", F.col("error").isNotNull())
            .withColumn("queued_at", F.col("timestamp"))
        )
        write_outcomes(route(tried, at), self.queue.results, self.batch_id)
        self.batch_id += 1


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def totals(queue):
    return {
        r.run: (r.queued, r.deliveries, r.acknowledged, r.dead_letters)
        for r in queue.runs().collect()
    }


@pytest.mark.parametrize("settle_often", [True])
def test_two_rounds_each_get_their_retries_and_dead_letters(spark, queue, settle_often):
    consumer = Consumer(queue)
    for round_no, run in enumerate((1_000, 500_000_000)):
        enqueue(ids(spark, "a", "b", "c"), queue.messages, run)
        with pytest.raises(RuntimeError, match="3 snippets"):
            queue.check_idle()
        assert queue.state().first()["status"] == "processing"
        now, fed = run, []
        for _ in range(4):
            consumer.take(now)
            if settle_often:
                assert queue.settle() and not queue.settle()
            assert [r.snippet_id for r in queue.in_flight().collect()] == ["b"] * (len(fed) < 3)
            now += LATER
            assert queue.feed_retries(now - LATER) == 0  # not due yet
            fed.append(queue.feed_retries(now))
            assert queue.feed_retries(now) == 0
        assert fed == [1, 1, 1, 0]
        queue.check_idle()
        queue.write_dead_letters()
        row = queue.state().first()
        assert (row.status, row.in_flight, row.dead_letters) == ("completed", 0, round_no + 1)
        assert row.queued == 6 * (round_no + 1)
    dead = sorted((r.snippet_id, r.run, r.attempts) for r in queue.read_dead_letters().collect())
    assert dead == [("b", 1_000, 4), ("b", 500_000_000, 4)]
    assert totals(queue) == {1_000: (3, 6, 1, 1), 500_000_000: (3, 6, 1, 1)}


@pytest.mark.parametrize("stop_at", ["settled", "manifest"])
def test_a_stop_while_settling_changes_nothing(spark, queue, monkeypatch, stop_at):
    from pyspark.sql import DataFrameWriter

    consumer = Consumer(queue)
    enqueue(ids(spark, "a", "b"), queue.messages, 1_000)
    consumer.take(1_000)
    before = totals(queue), queue.state().first()

    def stopping(real):
        def write(self, path, *args, **kwargs):
            if f"/ledger/{stop_at}" in path:
                raise KeyboardInterrupt
            return real(self, path, *args, **kwargs)

        return write

    with monkeypatch.context() as patched:
        for name in ("parquet", "json"):
            patched.setattr(DataFrameWriter, name, stopping(getattr(DataFrameWriter, name)))
        with pytest.raises(KeyboardInterrupt):
            queue.settle()
    assert (totals(queue), queue.state().first()) == before
    assert queue.read_dead_letters().count() == 0
    assert queue.settle()
    assert (totals(queue), queue.state().first()) == before
    assert queue.feed_retries(LATER) == 1


def test_rows_delivered_twice_count_once(spark, queue):
    consumer = Consumer(queue)
    for _ in range(2):
        enqueue(ids(spark, "a", "b"), queue.messages, 1_000)
    consumer.take(1_000)
    consumer.take(1_000)  # the same deliveries in another batch
    assert totals(queue) == {1_000: (2, 2, 1, 0)}
    assert queue.feed_retries(LATER) == 1


def test_only_open_work_is_read_after_settling(spark, queue, tmp_path):
    """Batches are bounded, read files are archived, and settled batches not read again."""
    archive, marks = tmp_path / "archive", str(tmp_path / "marks")
    many = spark.range(40).select(F.format_string("s%03d", "id").alias("id")).coalesce(1)
    enqueue(many, queue.messages, 1_000, rows_per_file=10)
    sizes = []

    def run(batch, batch_id):
        sizes.append(batch.count())
        done = batch.withColumn("failed", F.lit(False)).withColumn(
            "error", F.lit(None).cast("string")).withColumn("queued_at", F.col("timestamp"))
        write_outcomes(route(done, 1_000), queue.results, batch_id)

    def drain():
        stream = read_messages(
            spark, queue.messages, max_files=2, archive=str(archive),
        ).writeStream.foreachBatch(run)
        stream.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    drain()
    assert sizes == [20, 20]
    enqueue(ids(spark, "late"), queue.messages, 2_000)
    drain()
    assert sizes == [20, 20, 1]
    assert len(list(archive.rglob("part-*.parquet"))) >= 4
    assert queue.delivered().count() <= 1
    assert queue.settle() and queue.state().first()["queued"] == 41
    # outcomes of settled batches are no longer needed
    for folder in sorted(Path(queue.results, "outcomes").glob("batch_id=*"))[:-1]:
        for file in folder.glob("*"):
            file.unlink()
    row = queue.state().first()
    assert (row.status, row.queued, row.acknowledged) == ("completed", 41, 41)


def test_messages_name_their_round(spark):
    row = as_messages(ids(spark, "a"), 7).first()
    assert (row.timestamp, row.run, row.attempts) == (7, 7, 1)
