import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.config import WORD
from tagloom.functions.plan_text import extract_json, parse_plan, scrub_json
from tagloom.operators import consolidate as con
from tagloom.operators import leaders
from tagloom.operators import merge_plans as mp
from tests.reference_rules import merge_arrays

GROUP = '{"primary_tag_id": 1, "primary_tag_name": "a", "merge_tag_ids": [2, 3], "reason": "r"}'


def parsed(spark, reply):
    df = spark.createDataFrame([(reply,)], "reply string")
    return [g.asDict() for g in df.select(parse_plan(F.col("reply")).alias("p")).first()["p"]]


@pytest.mark.parametrize("reply", [
    '```json\n{"consolidations": [%s]}\n```' % GROUP,
    '```\n{"consolidations": [%s]}```' % GROUP,
    'Sure! {"consolidations": [%s]} That is all.' % GROUP,
    '{"consolidations": [ // first\n%s]}' % GROUP,
    '{"consolidations": /* one\ntwo */ [%s]}' % GROUP,
    '{"consolidations": [%s,],}' % GROUP,
])
def test_wrappings_give_the_same_plan(spark, reply):
    assert parsed(spark, reply) == [{
        "primary_tag_id": 1, "primary_tag_name": "a",
        "merge_tag_ids": [2, 3], "reason": "r",
    }]


@pytest.mark.parametrize("reply", [
    "no braces", '{"consolidations": [%s' % GROUP[:-1], '{"consolidations": [%s]} or {}' % GROUP,
    '{"consolidations": [%s]}, {}' % GROUP, "{'consolidations': []}", '{"other": 1}', "{bad}",
    '{"consolidations": 5}', "", None,
])
def test_unreadable_replies_are_empty_plans(spark, reply):
    assert parsed(spark, reply) == []


def test_line_comments_go_even_inside_strings(spark):
    df = spark.createDataFrame([('{"a": "http://x"\n}',)], "r string")
    assert df.select(scrub_json(F.col("r")).alias("s")).first()["s"] == '{"a": "http:\n}'


def test_fenced_object_comes_before_the_outer_braces(spark):
    df = spark.createDataFrame([('{x} ```{"a": {"b": 1}}``` {y}',)], "r string")
    assert df.select(extract_json(F.col("r")).alias("s")).first()["s"] == '{"a": {"b": 1}}'


def tags_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string, usage_count bigint")


def reply_of(spark, *groups):
    text = json.dumps({"consolidations": list(groups)})
    return spark.createDataFrame([(1, text)], "reply_no bigint, reply string")


def group(primary, merges, name=None, reason="r"):
    return {"primary_tag_id": primary, "primary_tag_name": name,
            "merge_tag_ids": merges, "reason": reason}


def resolved(spark, tags, *groups):
    valid = mp.valid_groups(mp.plan_groups(reply_of(spark, *groups)), tags)
    return mp.resolve_overlaps(valid)


def test_validation_and_overlaps(spark):
    tags = tags_of(spark, [(i, f"tag{i}", i) for i in range(1, 9)])
    rows = resolved(
        spark, tags,
        group(1, [2, 1, 99, 2], reason=""),   # self merge, unknown id, repeat
        group("3", [4]),                      # text id
        group(3, []),                         # nothing to merge
        group(77, [4]),                       # unknown primary
        group(2, [5]),                        # primary merged before
        group(6, [1, 7]),                     # names an earlier primary
    ).collect()
    got = {(r["primary_id"], r["merge_id"], r["pos"]): r["verdict"] for r in rows}
    assert got == {
        (1, 2, 1): "merge", (1, 1, 2): "self merge", (1, 2, 4): "already named",
        (2, 5, 1): "primary taken", (6, 1, 1): "already named", (6, 7, 2): "merge",
    }
    assert {r["reason"] for r in rows if r["primary_id"] == 1} == {"No reason provided"}


def test_a_text_among_the_merge_ids_is_dropped_alone(spark):
    tags = tags_of(spark, [(i, f"tag{i}", i) for i in range(1, 5)])
    rows = resolved(spark, tags, group(1, [2, "3", 4.0, [3], 3.5, None])).collect()
    assert sorted(r["merge_id"] for r in rows) == [2, 4]


def test_renames(spark):
    tags = tags_of(spark, [(1, "alpha", 1), (2, "beta", 1), (3, "gamma", 1), (4, "delta", 1),
                           (5, "omega", 1), (6, "sigma", 1), (7, "kappa", 1), (8, "zeta", 1)])
    mapping = mp.merge_mapping(resolved(
        spark, tags,
        group(1, [2], "alphabet"), group(3, [4], "omega"), group(5, [6], "om"),
        group(7, [8], "alpha-bet"),
    ))
    asked = mp.renames(mapping, tags, WORD)
    verdicts = {r["primary_id"]: r["verdict"] for r in asked.collect()}
    assert verdicts == {1: "rename", 3: "name in use", 5: "invalid name", 7: "name in use"}
    names = {r["id"]: r["name"] for r in con.rename_tags(tags, asked).collect()}
    assert names[1] == "alphabet" and names[3] == "gamma" and names[7] == "kappa"


def test_usage_rolls_up(spark):
    tags = tags_of(spark, [(1, "a", 10), (2, "b", 5), (3, "c", 3), (4, "d", 8), (5, "e", 2)])
    mapping = mp.merge_mapping(resolved(spark, tags, group(1, [2, 3]), group(4, [5])))
    got = {r["id"]: r["usage_count"] for r in con.rollup_usage(tags, mapping).collect()}
    assert got == {1: 18, 4: 10}


def test_arrays_and_junction_equal_the_step_by_step_rule(spark):
    lists = {
        "a": [12, 7, 5], "b": [5, 5, 1], "c": [5], "d": [7], "e": None, "f": [2, 3, 12],
        "g": [], "h": [3, 1, 2],
    }
    pairs = {(s, t) for s, ts in lists.items() if ts for t in ts}
    pairs |= {("e", 5), ("g", 12), ("d", 3)}
    groups = [(1, [5]), (2, [12, 3])]
    want_lists, want_pairs = merge_arrays(lists, pairs, groups)
    snippets = spark.createDataFrame(
        [(s, None if ts is None else json.dumps(ts, separators=(",", ":")))
         for s, ts in lists.items()] + [("x", "[broken")],
        "id string, tags string",
    )
    junction = spark.createDataFrame(sorted(pairs) + [("x", 5)], "snippet_id string, tag_id bigint")
    tags = tags_of(spark, [(t, f"t{t}", 1) for t in (1, 2, 3, 5, 7, 12)])
    mapping = mp.merge_mapping(resolved(spark, tags, *[group(p, m) for p, m in groups]))
    rewritten = {r["id"]: r["tags"] for r in con.rewrite_arrays(snippets, junction, mapping).collect()}
    assert rewritten.pop("x") == "[broken"
    assert {s: None if t is None else json.loads(t) for s, t in rewritten.items()} == want_lists
    moved = {tuple(r) for r in con.remap_pairs(junction, mapping).collect()}
    assert moved == want_pairs | {("x", 1)}
    report = con.consolidation_report(mapping, junction, snippets).collect()
    assert {r["primary_id"]: r["snippets_updated"] for r in report} == {
        1: 3,  # a b c; e has no list and x an unreadable one
        2: 6,  # a f g for 12, d f h for 3
    }


def test_star_groups_keep_the_ten_best(spark):
    tags = tags_of(spark, [(i, f"t{i}", 100 - i) for i in range(1, 14)])
    pairs = spark.createDataFrame(
        [(1, i, i / 100) for i in range(2, 14)], "a bigint, b bigint, similarity double")
    got = mp.star_groups(tags, pairs, "x").collect()
    assert [r["merge_id"] for r in sorted(got, key=lambda r: r["pos"])] == list(range(13, 3, -1))


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_cosine_pairs_do_not_depend_on_blocks(spark, block_rows):
    import numpy as np

    vectors = np.random.default_rng(5).normal(size=(20, 4))
    frame = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(vectors)],
        "id bigint, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    full = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(20) for j in range(i + 1, 20) if full[i, j] >= 0.6}
    got = mp.cosine_pairs(frame, 0.6, block_rows).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_jaccard_pairs(spark):
    pairs = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("c", 3), ("d", 4)]
    frame = spark.createDataFrame(pairs, "snippet_id string, tag_id bigint")
    got = {(r["a"], r["b"]): r["similarity"] for r in mp.jaccard_pairs(frame, 0.3).collect()}
    assert got == {(1, 2): pytest.approx(2 / 3), (2, 3): pytest.approx(1 / 3)}


def test_edit_plan_broadcasts_nothing(spark, monkeypatch):
    """Before, the driver built whole tables of keys and tags, taken for small ones."""
    plans = []

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def kept(df, name, base=leaders.materialize):
        plans.append(plan_of(df))
        return base(df, name)

    monkeypatch.setattr(leaders, "materialize", kept)
    monkeypatch.setattr(mp, "materialize", kept)
    names = ["abcdefgh", "abcdefgx", "abcdefxx", "Abcdefgh", "mnopqrst", "mnopqrsx",
             "abcdefghijklmnopqr", "abcdefghijklmnopxx", "zzzzz"]
    tags = tags_of(spark, [(i, n, 100 - i) for i, n in enumerate(names, 1)])
    groups = mp.plan_by_similarity(tags, "edit", 0.75)
    plans.append(plan_of(groups))
    got = sorted((r["primary_id"], r["pos"], r["merge_id"]) for r in groups.collect())
    assert got == [(1, 1, 4), (1, 2, 2), (1, 3, 3), (5, 1, 6), (7, 1, 8)]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_followers_of_many_rounds_come_in_one_scan(spark):
    """Before, every round added a plan of its own to the result's."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "earlier bigint, later bigint")
    lost = leaders.followers(edges)
    assert lost._jdf.queryExecution().analyzed().collectLeaves().size() == 1
    assert sorted(r["item"] for r in lost.collect()) == [2, 4, 6, 8]


def test_cosine_plan_works_out_no_pairs_of_followers(spark, monkeypatch):
    """Copies are pairs with their leader only; before, every two of them were."""
    rows = []
    kept = mp.materialize

    def watched(df, name):
        out = kept(df, name)
        if name == "similar-tags":
            rows.append(out.count())
        return out

    monkeypatch.setattr(mp, "materialize", watched)
    tags = spark.range(1, 301).select(
        "id", F.concat(F.lit("t"), "id").alias("name"), F.lit(1).cast("bigint").alias("usage_count")
    )
    vectors = tags.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    got = mp.plan_by_similarity(tags, "cosine", 0.9, vectors=vectors).collect()
    assert {r["primary_id"] for r in got} == {1}
    assert sorted(r["merge_id"] for r in got) == list(range(2, 12))
    assert rows == [299]


def test_cosine_leaders_in_rounds_are_those_of_all_pairs(spark):
    """Also for rows without id or vector, repeated ids and vectors of length 0."""
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(1, 90)]
    vectors += [(3, rng.normal(size=6).tolist()), (None, [1.0] * 6), (95, [0.0] * 6), (999, [1.0] * 6)]
    tags = spark.createDataFrame(
        [(i, f"t{i}", int(rng.integers(1, 9))) for i in range(1, 100)],
        "id bigint, name string, usage_count bigint",
    )
    frame = spark.createDataFrame(vectors, "id bigint, vector array<double>")
    without = frame.unionByName(spark.createDataFrame([(96, None)], frame.schema))
    want = mp.star_groups(tags, mp.cosine_pairs(frame.dropna(), 0.6), "x").collect()
    got = mp.star_groups(tags, mp.leader_pairs(tags, without, 0.6, head_tags=7), "x").collect()
    assert sorted(got) == sorted(want) and len(want) > 20
