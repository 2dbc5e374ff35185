"""Buckets, merges in the manifest, deletes: what a publish writes and what it can't break."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagloom.config import WORD
from tagloom.operators.consolidate import merge_forest
from tagloom.operators.integrity import integrity_report
from tagloom.plans import maintenance
from tagloom.plans.tagging import Settings, tag_batch
from tagloom.sources.schemas import SNIPPETS, TAGS
from tagloom.sources.tables import TableStore
from tagloom.streaming.tagging import final_tags

N = 150


def words(documents):
    return documents.select("id", F.split("text", " ").alias("names"))


@pytest.fixture
def store(spark, tmp_path):
    made = TableStore(spark, str(tmp_path / "tables"), rows_per_bucket=10)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SNIPPETS)
    rows = [(f"s{i:04d}", "t", "a", i, "u", None, None) for i in range(N)]
    snippets = spark.createDataFrame(rows, schema)
    made.publish({"snippets": snippets.withColumn("created_at", F.current_timestamp())})
    return made


def files(store):
    return {
        str(f.relative_to(store.base)) for f in Path(store.base).rglob("*.parquet")
    }


def test_ten_snippets_rewrite_their_buckets_only(spark, store):
    before = store.snapshot()
    assert before.layouts["snippets"].buckets == 15
    rows = [(f"s{i:04d}", "alpha" if i % 2 else "bravo delta") for i in range(N)]
    content = spark.createDataFrame(rows, "id string, text string")
    old = files(store)
    tag_batch(store, content, words, Settings(WORD), batch_size=10)
    after = store.snapshot()
    ids = spark.createDataFrame([(f"s{i:04d}",) for i in range(10)], "id string")
    own = before.touched("snippets", ids)
    assert 1 < len(own) <= 10
    new = {f for f in files(store) - old if f.startswith("snippets/")}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == own
    assert old <= files(store)
    assert after.snippets.count() == N
    tagged = {r.id: r.tags for r in after.snippets.where("tags is not null").collect()}
    assert tagged == {f"s{i:04d}": "[3]" if i % 2 else "[1,2]" for i in range(10)}
    assert sorted(r.name for r in after.tags.collect()) == ["alpha", "bravo", "delta"]
    # what a reader took before still reads the same
    assert before.snippets.where("tags is not null").isEmpty()
    # the whole backlog later touches all buckets once more
    tag_batch(store, content, words, Settings(WORD), batch_size=None)
    assert store.read_snippets().where("tags is null").isEmpty()
    assert store.read_snippet_tags().count() == N + N // 2
    counts = {r.name: r.usage_count for r in store.read_tags().collect()}
    assert counts == {"alpha": N // 2, "bravo": N // 2, "delta": N // 2}
    report = integrity_report(*(store.snapshot().read(t) for t in ("snippets", "tags", "snippet_tags")))
    assert report.where("n_rows > 0").isEmpty()


@pytest.fixture
def tagged(spark, store):
    tags = spark.createDataFrame(
        [(i, n, None, 1) for i, n in enumerate(["ant", "ants", "bee", "cat"], 1)],
        "id long, name string, created_at timestamp, usage_count long",
    ).withColumn("created_at", F.current_timestamp()).select(*TAGS.names)
    pairs = spark.createDataFrame(
        [("s0001", 1), ("s0002", 2), ("s0003", 2), ("s0003", 3), ("s0004", 4)],
        "snippet_id string, tag_id long",
    )
    lists = {"s0001": "[1]", "s0002": "[2]", "s0003": "[2,3]", "s0004": "[4]"}
    column = F.element_at(F.create_map(*(F.lit(x) for kv in lists.items() for x in kv)), F.col("id"))
    snippets = store.read_snippets().withColumn("tags", column)
    store.publish({"snippets": snippets, "tags": tags, "snippet_tags": pairs}, high_water=4)
    return store


def contents(store):
    now = store.snapshot()
    return (
        sorted((r.id, r.tags) for r in now.snippets.where("tags is not null").collect()),
        sorted((r.id, r.name, r.usage_count) for r in now.tags.collect()),
        sorted(map(tuple, now.snippet_tags.collect())),
        sorted(map(tuple, now.merges.collect())),
    )


MERGED = (
    [("s0001", "[1]"), ("s0002", "[1]"), ("s0003", "[3,1]"), ("s0004", "[4]")],
    [(1, "ant", 2), (3, "bee", 1), (4, "cat", 1)],
    [("s0001", 1), ("s0002", 1), ("s0003", 1), ("s0003", 3), ("s0004", 4)],
    [(2, 1)],
)




def groups_of(store, *groups):
    reply = json.dumps({"consolidations": [
        {"primary_tag_id": g[0], "primary_tag_name": None, "merge_tag_ids": g[1:], "reason": ""}
        for g in groups
    ]})
    return store.spark.createDataFrame([(1, reply)], "reply_no bigint, reply string")


@pytest.mark.parametrize("stop_at", ["/snippet_tags/", "/_manifest/"])
def test_consolidating_again_after_a_stop(tagged, monkeypatch, stop_at):
    from pyspark.sql import DataFrameWriter

    before = contents(tagged)
    replies = groups_of(tagged, (1, 2))

    def stopping(real):
        def write(self, path, *args, **kwargs):
            if path.startswith(tagged.base) and stop_at in path:
                raise KeyboardInterrupt
            return real(self, path, *args, **kwargs)

        return write

    with monkeypatch.context() as patched:
        for name in ("parquet", "json"):
            patched.setattr(DataFrameWriter, name, stopping(getattr(DataFrameWriter, name)))
        with pytest.raises(KeyboardInterrupt):
            maintenance.consolidate(tagged, replies, profile=WORD)
    assert contents(tagged) == before
    # the next plan merges the other way round, the one after that as before
    if stop_at == "/_manifest/":
        maintenance.consolidate(tagged, groups_of(tagged, (2, 1)), profile=WORD)
        assert contents(tagged)[3] == [(1, 2)]
    else:
        maintenance.consolidate(tagged, replies, profile=WORD)
        assert contents(tagged) == MERGED


def test_merges_of_merges_stand_for_the_last(spark, tagged):
    maintenance.consolidate(tagged, groups_of(tagged, (1, 2)), profile=WORD)
    maintenance.consolidate(tagged, groups_of(tagged, (3, 1)), profile=WORD)
    now = tagged.snapshot()
    assert sorted(map(tuple, now.merges.collect())) == [(1, 3), (2, 3)]
    none = spark.createDataFrame([], "tag_id long, key string")
    final = sorted(map(tuple, final_tags(none, now.tags, now.merges).collect()))
    assert final == [(1, 3), (2, 3), (3, 3), (4, 4)]


def test_forests(spark):
    schema = "merge_id long, primary_id long"

    def forest(old, new):
        frames = (spark.createDataFrame(rows, schema) for rows in (old, new))
        return dict(map(tuple, merge_forest(*frames).collect()))

    chain = [(i, i + 1) for i in range(1, 60)]
    assert forest(chain[::2], chain[1::2]) == {i: 60 for i in range(1, 60)}
    assert forest([(1, 2)], [(1, 3)]) == {1: 2}
    assert forest([], []) == {}
    for circle in ([(1, 2), (2, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 1), (9, 1)]):
        with pytest.raises(ValueError, match="circle"):
            forest([], circle)


def test_deletes_take_their_pairs_along(spark, tagged):
    old = files(tagged)

    def ids(*values):
        kind = "long" if isinstance(values[0], int) else "string"
        return spark.createDataFrame([(v,) for v in values], f"id {kind}")

    maintenance.delete_rows(tagged, snippets=ids("s0003", "nobody"), tags=ids(1, 99))
    now = tagged.snapshot()
    assert sorted(map(tuple, now.snippet_tags.collect())) == [("s0002", 2), ("s0004", 4)]
    assert [r.id for r in now.tags.orderBy("id").collect()] == [2, 3, 4]
    assert now.snippets.count() == N - 1 and now.high_water == 4
    new = {f for f in files(tagged) - old if f.startswith("snippets/")}
    assert 1 <= len(new) <= 2
    maintenance.delete_rows(tagged)
    assert tagged.snapshot().version == now.version
