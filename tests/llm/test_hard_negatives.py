"""Hard negatives against every pair's score."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import hard_negatives as h
from tagloom.llm.hard_negatives import Tile, mine_hard_negatives, tiled_order

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<double>, rank string, point int"


def brute(rows, is_anchor, n_positives=5, n_negatives=3):
    rows = [
        (i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
        if None not in (i, label, v) and None not in v and all(map(math.isfinite, v))
    ]
    out = []
    for a, label, p in filter(lambda r: is_anchor(r[0]), rows):
        scored = sorted(
            (-sum(x * y for x, y in zip(p, q)), i, other == label)
            for i, other, q in rows if i != a and len(q) == len(p)
        )
        for positive, i, _ in [s for s in scored if s[2]][:n_positives]:
            near = [
                s for s in scored
                if not s[2] and 50 * -positive <= 100 * -s[0] <= 95 * -positive
            ]
            out += [
                (a, i, rank, n[1], -positive, -n[0])
                for rank, n in enumerate(near[:n_negatives], 1)
            ]
    return sorted(out)


def mined(df, step=5):
    found = mine_hard_negatives(df, F.col("vec_id") % step == 0)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


@pytest.fixture
def small_boxes(monkeypatch):
    """Many tiles, blocks and chunks from few rows."""
    monkeypatch.setattr(h, "TILE_VALUES", 500)
    monkeypatch.setattr(h, "BLOCK", 7)
    monkeypatch.setattr(h, "CHUNK", 3)


def test_equals_every_pair(spark, small_boxes):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(4, 6)) * 0.5
    rows = []
    for i in range(400):
        label = 1 if i % 3 == 0 else int(draw.integers(0, 4))  # a third has one label
        v = (centres[label] + draw.normal(size=6) * 0.3).round(2)
        rows.append((i, label, v.tolist() if i % 4 else centres[1].round(2).tolist()))
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 300 and mined(df.repartition(5)) == want


def test_odd_rows(spark, small_boxes):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 1, [0.9, 1.9]), (3, 2, [0.9, 1.5]),
        (4, 2, [0.8, 1.5]), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [nan, 1.0]),
        (8, 2, [inf, 1.0]), (9, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (10, 3, [1.0]),
        (11, 3, []), (15, 3, []), (12, 2, [0.9, 1.5]), (20, 2, [-1.0, -1.0]), (21, 2, [-1.0, 1.5]),
        (25, 7, [3e15, -2.5e15]), (26, 7, [3e15, -2.4e15]), (27, 8, [2e15, -2.4e15]),
        (30, 1, [1.0, 2.0]), (30, 1, [0.5, 1.0]),
    ]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    want = brute(rows, lambda i: i % 5 == 0)
    clipped = [(*r[:4], *(min(s, 2**62) for s in r[4:])) for r in want]
    assert [r for r in mined(df) if r[0] != 25] == [r for r in clipped if r[0] != 25]
    assert mined(df.where("vec_id < 0")) == []


def test_text_labels(spark):
    rows = [(0, "a", [1.0]), (1, "a", [2.0]), (2, "b", [1.5]), (3, "c", [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    assert mined(df) == [(0, 1, 1, 2, 131072, 98304), (0, 1, 2, 3, 131072, 65536)]


def test_boxes_are_left_out():
    """Leaves that can't hold a hit are never scored, whatever the order of rows."""
    draw = np.random.default_rng(8)
    points = draw.integers(-300, 300, (4_096, 3))
    ids, labels = np.arange(4_096), np.zeros(4_096, int)
    order = tiled_order(points, labels, ids)
    assert sorted(order.tolist()) == ids.tolist()
    points, ids = points[order], ids[order]
    firsts = np.arange(0, 4_096, h.LEAF)
    low, high = (f.reduceat(points, firsts) for f in (np.minimum, np.maximum))
    tile = Tile(3, *(x.astype("<i8").tobytes() for x in (ids, labels, points, low, high)))
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            if isinstance(rows, slice) and rows.step is None and rows.stop is not None:
                opened.append(rows.start)
            return np.asarray(super().__getitem__(rows))

    tile.ids = tile.ids.view(Counted)
    query = np.array([[200, -100, 50]])
    floors, highs = np.array([[-(2**62)]]), np.array([[2**62]])
    got = tile.search(query, np.array([-1]), np.array([0]), floors, highs, True, 5)
    scores = points @ query[0]
    best = np.lexsort((ids, -scores))[:5]
    assert sorted((r[2], r[3]) for r in got) == sorted(zip(ids[best].tolist(), scores[best].tolist()))
    assert 0 < len(opened) <= 8  # of 64
    opened.clear()
    window = np.array([[1_000]]), np.array([[1_010]])
    got = tile.search(query, np.array([-1]), np.array([1]), *window, False, 10_000)
    assert {r[2] for r in got} == set(ids[(scores >= 1_000) & (scores <= 1_010)].tolist())
    assert len(opened) < 40


def test_scores_by_label(spark):
    """A query over its own label never returns another one, and the other way round."""
    rows = [(i, i % 2, [float(i % 7), 1.0]) for i in range(60)]
    labels = defaultdict(int, {i: label for i, label, _ in rows})
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for anchor, positive, _, negative, *_ in mined(df, 10):
        assert labels[anchor] == labels[positive] != labels[negative]
