"""Documents put together from the same passages: only pairs near a link meet."""

import random
from collections import Counter

import numpy as np

from tagloom.llm import ngram_join as n

PERCENT = 80


def prefix(grams):
    return sorted(grams)[: n.prefix_size(len(grams), PERCENT)]


def links(x, y):
    return 100 * len(x & y) >= PERCENT * len(x | y)


def test_meetings_of_a_group_that_hardly_links(spark):
    """Before, all pairs that held a frequent n-gram of a prefix became rows."""
    rnd = random.Random(5)
    base = [rnd.getrandbits(62) for _ in range(300)]
    sets = [set(rnd.sample(base, rnd.randint(120, 200))) for _ in range(121)]
    for i in range(20):  # some near copies
        drop = rnd.sample(sorted(sets[i]), rnd.choice([0, 5, 20, 60]))
        sets.append(sets[i].difference(drop) | {rnd.getrandbits(62) for _ in range(10)})
    sets += [{1, 2, 3, k} for k in range(10, 14)] + [{1, 2, 3}, {1}, {1, 2}]
    met = {g: k for g, k in Counter(g for s in sets for g in prefix(s)).items() if k > 1}
    assert max(met.values()) > 4 * n.MANY_HOLDERS
    rows = [
        (g, i, len(s), at, i, i % 3, met[g])
        for i, s in enumerate(sets) for at, g in enumerate(prefix(s)) if g in met
    ]
    rows = spark.createDataFrame(
        rows, "gram long, id long, n long, at int, component long, family long, held long")
    sketches = spark.createDataFrame(
        [(i, n.sketch(np.array(sorted(s), np.uint64)).tolist()) for i, s in enumerate(sets)],
        "id long, sketch array<long>")
    got = Counter(
        (min(r["a"], r["b"]), max(r["a"], r["b"]))
        for r in n.meetings(rows, sketches, ["family"], PERCENT).collect())
    wanted = [(i, j) for j in range(len(sets)) for i in range(j) if i % 3 != j % 3]
    linked = {(i, j) for i, j in wanted if links(sets[i], sets[j])}
    assert len(linked) > 10
    for i, j in linked:  # a row for each n-gram that both prefixes have
        common = set(prefix(sets[i])) & set(prefix(sets[j]))
        assert got[i, j] == len(common)
    assert all(i % 3 != j % 3 for i, j in got)
    by_many = {g for g, k in met.items() if k >= n.MANY_HOLDERS}
    firsts = [set(prefix(s)) & met.keys() for s in sets]
    only = {(i, j) for i, j in wanted if (c := firsts[i] & firsts[j]) and c <= by_many}
    assert len(only) > 1000 and len(only & got.keys()) < 3 * len(linked)


def test_sketches_never_differ_in_more_bits_than_sets(spark):
    rng = np.random.default_rng(3)
    for size, other in [(0, 0), (0, 5), (300, 10), (300, 3000)]:
        x = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        y = np.unique(np.concatenate([x[size // 10:], rng.integers(0, 1 << 63, other, np.uint64)]))
        bits = np.unpackbits((n.sketch(x) ^ n.sketch(y)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(x, y)) and len(n.sketch(x)) == n.SKETCH_WORDS
