import random

import pytest

from tagloom.operators.leaders import followers
from tagloom.operators.matching import best_match, fuzzy_pairs
from tagloom.operators.vocabulary import assign_tags, grow_vocabulary
from tests.reference_rules import grow_and_assign, similarity


def variants(rng, words, edits, letters="abc"):
    out = set(words)
    for word in words:
        for _ in range(3):
            w = list(word)
            for _ in range(rng.randint(1, edits)):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(at, rng.choice(letters))
                elif w and kind == 1:
                    del w[at - 1]
                elif w:
                    w[at - 1] = rng.choice(letters)
            out.add("".join(w))
    return sorted(w for w in out if w)


def names_of(rng, n, low, high, edits):
    return variants(
        rng, ["".join(rng.choice("abc") for _ in range(rng.randint(low, high))) for _ in range(n)],
        edits)


@pytest.mark.parametrize("theta, low, high, edits", [
    (0.8, 1, 14, 3), (0.7, 3, 15, 4), (0.8, 15, 32, 6), (0.9, 18, 45, 4),
])
def test_pairs_equal_brute_force(spark, theta, low, high, edits):
    rng = random.Random(f"{theta}{low}")
    left, right = names_of(rng, 40, low, high, edits), names_of(rng, 40, low, high, edits)
    right = sorted(set(right) | set(variants(rng, left[::3], edits)))
    make = lambda ns: spark.createDataFrame([(n,) for n in ns], "name string")
    got = fuzzy_pairs(make(left), make(right), theta).collect()
    want = {(a, b) for a in left for b in right if similarity(a, b) >= theta}
    assert {(r["left_name"], r["right_name"]) for r in got} == want
    assert len(got) == len(want) > len(set(left) & set(right))
    once = fuzzy_pairs(make(left), make(left), theta, once=True).collect()
    assert {(r["left_name"], r["right_name"]) for r in once} == {
        (a, b) for a in left for b in left if a < b and similarity(a, b) >= theta}


def test_best_match_prefers_similarity_then_the_lowest_id(spark):
    tags = spark.createDataFrame([(3, "abcdefg"), (1, "abcdezz"), (2, "abcdeyy")], "id bigint, name string")
    names = spark.createDataFrame([("abcdefg",), ("abcdeff",), ("abcdezy",)], "name string")
    pairs = fuzzy_pairs(names, tags.select("name"), 0.7)
    got = {r["left_name"]: r["tag_id"] for r in best_match(pairs, tags).collect()}
    assert got == {"abcdefg": 3, "abcdeff": 3, "abcdezy": 1}


def test_followers_along_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "earlier bigint, later bigint")
    assert sorted(r["item"] for r in followers(edges).collect()) == [2, 4, 6, 8]


@pytest.mark.parametrize("seed, cap", [(1, 3000), (2, 3000), (3, 14), (4, 40), (5, 8), (6, 0)])
def test_growth_and_assignment_equal_the_sequential_rule(spark, seed, cap):
    rng = random.Random(seed)
    pool = names_of(rng, 25, 3, 12, 2)
    existing = {i + 1: n for i, n in enumerate(rng.sample(pool, 6 if cap else 0))}
    rows = [
        (f"{s:03d}", i, rng.choice([str, str.upper, str.title])(rng.choice(pool)))
        for s in range(60) for i in range(1, rng.randint(1, 5))
    ]
    new, given = grow_and_assign(rows, existing, 0.8, cap, 50)
    proposals = spark.createDataFrame(rng.sample(rows, len(rows)), "id string, idx int, name string")
    vocabulary = spark.createDataFrame(list(existing.items()), "id bigint, name string")
    grown = grow_vocabulary(proposals, vocabulary, 0.8, cap, high_water=50)
    got = [(r["tag_id"], r["name"], r["born_id"], r["born_idx"]) for r in grown.collect()]
    assert sorted(got) == new
    assigned = assign_tags(proposals, vocabulary, grown, 0.8).collect()
    assert sorted((r["id"], r["idx"], r["tag_id"], r["is_new"]) for r in assigned) == given


def test_short_names_match_exactly_only(spark):
    proposals = spark.createDataFrame(
        [("1", 1, "激情"), ("1", 2, "激烈"), ("2", 1, "激情")], "id string, idx int, name string")
    vocabulary = spark.createDataFrame([], "id bigint, name string")
    grown = grow_vocabulary(proposals, vocabulary)
    assert [(r["tag_id"], r["name"]) for r in grown.orderBy("tag_id").collect()] == [(1, "激情"), (2, "激烈")]
    given = assign_tags(proposals, vocabulary, grown)
    assert sorted((r["id"], r["idx"], r["tag_id"], r["is_new"]) for r in given.collect()) == [
        ("1", 1, 1, True), ("1", 2, 2, True), ("2", 1, 1, False)]
