"""Hard negatives by inner product, searched best-first in a packed R-tree.

Vectors become integers, are sorted by label and first coordinate into ranges, and in
each range by one coordinate after the other (sort-tile-recursive): a group is cut in
two at the middle of its widest coordinate until it fits a leaf. Leaves and nodes of
``FANOUT`` leaves keep the least and largest value per coordinate; each coordinate
gives an interval of products with the query's value, and their sums bound all inner
products inside. A range is a tree (tile) of its own, a row of the index.

A query takes a queue of boxes by their upper bound. Boxes whose interval misses the
wanted scores, or whose upper bound is strictly below the k-th score so far, are never
opened. Over tiles that is done in two rounds: first the most promising tile, then all
others that the scores found there don't rule out. Queries go to tiles in blocks;
bounds of a block are worked out against a bounded number of tiles at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import travels_with_tasks, worker_cache
from tagloom.session import materialize

SCALE = 256
LEAF = 64
FANOUT = 16
TILE_VALUES = 1 << 19  # components in a tile: 8,192 vectors of 64
BLOCK = 4_096  # queries that go to a tile together
CHUNK = 2_048  # tiles whose boxes a block of queries meets at a time
LEAST, MOST = -(2**62), 2**62


def tiled_order(points: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Row numbers in tile order: by label, then halved along the widest coordinate."""
    order = np.lexsort((ids, labels))
    edges = np.flatnonzero(np.diff(labels[order])) + 1
    stack = [g for g in np.split(order, edges)][::-1]
    out = []
    while stack:
        group = stack.pop()
        if len(group) <= LEAF:
            out.append(group)
            continue
        own = points[group]
        axis = int(np.argmax(own.max(0).astype(float) - own.min(0)))
        group = group[np.argsort(own[:, axis], kind="stable")]
        half = max(LEAF, len(group) // 2 // LEAF * LEAF)
        stack += [group[half:], group[:half]]
    return np.concatenate(out) if out else order


def exact(points: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Arrays whose inner products are exact: doubles where they do, else integers."""
    def most(a: np.ndarray) -> int:
        return max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))

    bound = most(points) * max(map(most, others)) * max(1, points.shape[-1])
    kind = np.float64 if bound < 2**53 else object
    return [a.astype(kind) for a in (points, *others)]


def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Bounds of the inner products of each query with anything in each box."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Tile:
    """Leaves and nodes of one tile, for exact search."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, points: bytes, low: bytes, high: bytes):
        def matrix(raw: bytes) -> np.ndarray:
            return np.frombuffer(raw, "<i8").reshape(-1, dim) if dim else np.zeros((1, 0), "<i8")

        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.points = matrix(points) if dim else np.zeros((len(self.ids), 0), "<i8")
        n_leaves = -(-len(self.ids) // LEAF)
        self.low = matrix(low) if dim else np.zeros((n_leaves, 0), "<i8")
        self.high = matrix(high) if dim else np.zeros((n_leaves, 0), "<i8")
        firsts = np.arange(0, len(self.ids), LEAF)
        self.label_low = np.minimum.reduceat(self.labels, firsts)
        self.label_high = np.maximum.reduceat(self.labels, firsts)
        self.tops = np.arange(0, n_leaves, FANOUT)

    def search(self, queries, own, labels, floors, highs, same: bool, k: int):
        """``query, window, id, score`` of the first k rows in each query's windows.

        Rows of the query's label if ``same``, else all others; never its own id.
        Windows are closed; scores come from high to low, ids from low to high.
        """
        points, queries, low, high = exact(self.points, queries, self.low, self.high)
        node_low = np.minimum.reduceat(low, self.tops) if low.size else low[self.tops]
        node_high = np.maximum.reduceat(high, self.tops) if high.size else high[self.tops]
        least_label = np.minimum.reduceat(self.label_low, self.tops)
        last_label = np.maximum.reduceat(self.label_high, self.tops)
        bottoms, uppers = intervals(queries, node_low, node_high)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        out = []
        for q, query in enumerate(queries):
            label, least, most = labels[q], floors[q].tolist(), highs[q].tolist()
            found: list[list] = [[] for _ in least]

            def may_hold(first, last):
                if same:
                    return (first <= label) & (label <= last)
                return (first != label) | (last != label)

            def open_boxes(lows, ups, allowed, kind, base):
                good = allowed & (ups >= min(least)) & (lows <= max(most))
                for i in np.flatnonzero(good).tolist():
                    heapq.heappush(queue, (-ups[i], kind, base + i, lows[i]))

            queue: list = []
            open_boxes(bottoms[q], uppers[q], may_hold(least_label, last_label), 0, 0)
            while queue:
                upper, kind, box, bottom = heapq.heappop(queue)
                if -upper < min(least):
                    break
                if all(-upper < a or bottom > b for a, b in zip(least, most)):
                    continue
                if kind == 0:
                    leaves = slice(box * FANOUT, (box + 1) * FANOUT)
                    open_boxes(
                        low[leaves] @ up[q] + high[leaves] @ down[q],
                        high[leaves] @ up[q] + low[leaves] @ down[q],
                        may_hold(self.label_low[leaves], self.label_high[leaves]),
                        1, box * FANOUT,
                    )
                    continue
                rows = slice(box * LEAF, (box + 1) * LEAF)
                scores, ids = points[rows] @ query, self.ids[rows]
                right = (self.labels[rows] == label) == same
                some = np.flatnonzero(
                    right & (ids != own[q]) & (scores >= min(least)) & (scores <= max(most))
                )
                if not len(some):
                    continue
                scores, ids = scores[some], ids[some]
                for w, heap in enumerate(found):
                    spots = np.flatnonzero((scores >= least[w]) & (scores <= most[w]))
                    if len(spots) > k:
                        spots = spots[np.lexsort((ids[spots], -scores[spots]))[:k]]
                    for spot in spots.tolist():
                        entry = (int(scores[spot]), -int(ids[spot]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        else:
                            heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[w] = max(least[w], heap[0][0])
            for w, heap in enumerate(found):
                out += [(q, w, -i, score) for score, i in heap]
        return out


def usable(
    vectors: DataFrame, is_anchor: Column, id_col: str, label: str, vector: str
) -> DataFrame:
    """Rows that take part, with integer components and a number for the label."""
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    kind = vectors.schema[label].dataType
    number = F.col(label).cast("bigint") if isinstance(kind, T.IntegralType) else F.xxhash64(label)
    return vectors.where(
        F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
        & F.coalesce(F.forall(vector, finite), F.lit(False))
    ).select(
        F.col(id_col).cast("bigint").alias("id"), number.alias("label"),
        F.transform(vector, lambda x: F.floor(SCALE * x.cast("double"))).alias("point"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("uid"),
    ).withColumn("dim", F.size("point").cast("bigint"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows as tiles, one per number of components."""
    worker_cache("tiles")
    taken = list(batches)
    if not any(b.num_rows for b in taken):
        return
    rows = pa.Table.from_batches(taken)
    ids, labels, dims = (rows[c].to_numpy() for c in ("id", "label", "dim"))
    values = rows["point"].combine_chunks()
    starts = np.cumsum(dims) - dims
    flat = values.flatten().to_numpy()
    made = []
    for number, dim in enumerate(np.unique(dims).tolist()):
        own = np.flatnonzero(dims == dim)
        points = flat[starts[own][:, None] + np.arange(dim)].astype("<i8")
        if dim:
            order = tiled_order(points, labels[own], ids[own])
        else:
            order = np.lexsort((ids[own], labels[own]))
        points, own = points[order], own[order]
        firsts = np.arange(0, len(own), LEAF)
        low, high = (
            (f.reduceat(points, firsts) if dim else points[:0]) for f in (np.minimum, np.maximum)
        )
        made.append((
            TaskContext.get().partitionId() * 65_536 + number, dim,
            int(labels[own].min()), int(labels[own].max()),
            *(x.astype("<i8").tobytes() for x in (
                low.min(0) if dim else low, high.max(0) if dim else high,
                ids[own], labels[own], points, low, high,
            )),
        ))
    columns = list(zip(*made))
    yield pa.record_batch(
        [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.binary()) for c in columns[4:]],
        names=TILE_COLUMNS,
    )


BOX_COLUMNS = ["tile", "dim", "first_label", "last_label", "low", "high"]
TILE_COLUMNS = [*BOX_COLUMNS, "ids", "labels", "points", "leaf_low", "leaf_high"]
TILE_SCHEMA = ", ".join(
    f"{c} {'bigint' if i < 4 else 'binary'}" for i, c in enumerate(TILE_COLUMNS)
)


def packed_tree(rows: DataFrame) -> DataFrame:
    """The index: a row per tile. Every row of ``usable`` is in one, at its full length.

    Ranges have about ``TILE_VALUES`` components, so a frequent label, vector or first
    coordinate only takes more of them; ids part equal vectors.
    """
    values = rows.agg(F.sum(F.col("dim") + 1)).first()[0] or 0
    order = ["dim", "label", "_first", "id"]
    dealt = (
        rows.withColumn("_first", F.try_element_at("point", F.lit(1)))
        .repartitionByRange(max(1, -(-values // TILE_VALUES)), *order)
        .select("id", "label", "dim", "point")
    )
    return materialize(dealt.mapInArrow(_pack, TILE_SCHEMA), "tiles")


QUERY_COLUMNS = ["uid", "own", "label", "dim", "point", "lows", "highs", "floors"]
VISIT_SCHEMA = (
    "tile bigint, block bigint, uids array<bigint>, own array<bigint>, labels array<bigint>, "
    "queries binary, floors binary, tops binary"
)


def _windows(lists: pd.Series, fill: int) -> np.ndarray:
    width = max(map(len, lists))
    return np.array([[*x, *[fill] * (width - len(x))] for x in lists], np.int64)


def _reach(same: bool, first: bool):
    """Tiles that a block of queries has to visit: the best of these, or all others."""
    def reach(key: tuple, queries: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        dim, block, _ = key
        boxes, queries = boxes.sort_values("tile"), queries.sort_values("uid")
        if queries.empty or boxes.empty:
            return pd.DataFrame(columns=[x.split()[0] for x in VISIT_SCHEMA.split(", ")])

        def matrix(column) -> np.ndarray:
            return np.frombuffer(b"".join(column), "<i8").reshape(len(column), dim)

        points = np.array(queries["point"].tolist(), np.int64).reshape(len(queries), dim)
        exact_points, low, high = exact(points, matrix(boxes["low"]), matrix(boxes["high"]))
        bottoms, uppers = intervals(exact_points, low, high)
        lows, floors = _windows(queries["lows"], MOST), _windows(queries["floors"], MOST)
        highs = _windows(queries["highs"], LEAST)
        label = queries["label"].to_numpy()[:, None]
        begin, end = (boxes[c].to_numpy()[None, :] for c in ("first_label", "last_label"))
        fits = (begin <= label) & (label <= end) if same else (begin != label) | (end != label)

        def wanted(floors: np.ndarray) -> np.ndarray:
            good = np.zeros(fits.shape, bool)
            for w in range(floors.shape[1]):
                good |= (uppers >= floors[:, w, None]) & (bottoms <= highs[:, w, None])
            return good & fits

        possible = wanted(lows)
        ranked = np.where(possible, uppers.astype(float), -np.inf)
        best = np.zeros(fits.shape, bool)
        best[np.arange(len(points)), ranked.argmax(1)] = True
        visits = possible & best if first else wanted(floors) & possible & ~best
        out = []
        for column, tile in enumerate(boxes["tile"].tolist()):
            who = np.flatnonzero(visits[:, column])
            if len(who):
                some = queries.iloc[who]
                out.append((
                    tile, block, some["uid"].to_numpy(), some["own"].to_numpy(),
                    some["label"].to_numpy(),
                    *(x[who].astype("<i8").tobytes() for x in (points, floors, highs)),
                ))
        return pd.DataFrame(out, columns=[x.split()[0] for x in VISIT_SCHEMA.split(", ")])

    return reach


def _visit(same: bool, k: int):
    def visit(rows: pd.DataFrame) -> pd.DataFrame:
        worker_cache("tiles")
        out = []
        for row in rows.itertuples(index=False):
            tile = Tile(row.dim, row.ids, row.labels, row.points, row.leaf_low, row.leaf_high)
            n = len(row.uids)
            raw = (np.frombuffer(x, "<i8") for x in (row.queries, row.floors, row.tops))
            points, floors, highs = (
                x.reshape(n, -1) if x.size else np.zeros((n, 0), np.int64) for x in raw
            )
            found = tile.search(points, row.own, row.query_labels, floors, highs, same, k)
            out += [
                (row.uids[q], w, i, min(max(score, LEAST), MOST)) for q, w, i, score in found
            ]
        return pd.DataFrame(out, columns=["uid", "window", "id", "score"])

    return visit


def search_tree(tree: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """``uid, window, rank, id, score``: the first k rows in each window of each query.

    ``queries`` has ``uid, own, label, dim, point, lows, highs``; arrays ``lows`` and
    ``highs`` bound the scores of each window.
    """
    n_blocks = max(1, -(-queries.count() // BLOCK))
    n_chunks = max(1, -(-tree.count() // CHUNK))
    keys = ["dim", "block", "chunk"]
    boxes = tree.select(
        *BOX_COLUMNS, F.pmod(F.xxhash64("tile"), F.lit(n_chunks).cast("bigint")).alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"),
    )
    tiles = tree.drop("low", "high", "first_label", "last_label")

    def found(asked: DataFrame, first: bool) -> DataFrame:
        blocks = asked.select(
            *QUERY_COLUMNS, F.pmod(F.xxhash64("uid"), F.lit(n_blocks).cast("bigint")).alias("block"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_chunks - 1).cast("bigint"))).alias("chunk"),
        )
        visits = (
            blocks.groupBy(*keys).cogroup(boxes.groupBy(*keys))
            .applyInPandas(_reach(same, first), VISIT_SCHEMA)
            .withColumnRenamed("labels", "query_labels")
        )
        hits = (
            tiles.join(visits, "tile").groupBy("tile", "block")
            .applyInPandas(_visit(same, k), "uid bigint, window int, id bigint, score bigint")
        )
        return materialize(hits, "hits")

    def ranked(hits: DataFrame) -> DataFrame:
        order = W.partitionBy("uid", "window").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    early = found(queries.withColumn("floors", F.col("lows")), True)
    reached = (
        ranked(early).where(F.col("rank") == k).groupBy("uid")
        .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    )
    floor = F.transform("lows", lambda low, w: F.greatest(low, F.try_element_at("kth", w)))
    late = found(
        queries.join(reached, "uid", "left").withColumn("floors", F.coalesce(floor, "lows")), False
    )
    return ranked(early.unionByName(late))


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3,
    window: tuple[str, str] = ("0.50", "0.95"),
    id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """Rows of other labels whose score is a set share of a positive's.

    A score is the inner product of ``floor(256 x)``. Each row with ``is_anchor`` has
    its first ``n_positives`` other rows of its label as positives, and each of those
    the first ``n_negatives`` rows of other labels with a score between the two shares
    of ``window`` of the positive's score (both included): high scores first, ties by
    id. Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.

    Rows without an id, label or vector, or with a component that is null or not
    finite, take no part. Rows only meet rows of as many components. Every row of a
    repeated id counts, but none meets its own id. Whole numbers beyond 64 bits are
    held at 2**62 and 2**63. An empty table gives no rows; other columns aren't read.
    """
    rows = materialize(usable(vectors, is_anchor, id_col, label, vector), "vectors")
    tree = packed_tree(rows)
    queries = rows.where("anchor").select(
        "uid", F.col("id").alias("own"), "label", "dim", "point",
        F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"),
    )
    positives = materialize(search_tree(tree, queries, True, n_positives), "positives")
    share = F.col("score").cast("decimal(20,0)")
    lows, highs = (
        round_(share * F.lit(Decimal(part))).cast("bigint")
        for round_, part in zip((F.ceil, F.floor), window)
    )
    windows = positives.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("rank", lows.alias("low"), highs.alias("high"))))
        .alias("w")
    ).select("uid", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    narrowed = materialize(queries.drop("lows", "highs").join(windows, "uid"), "narrowed")
    negatives = search_tree(tree, narrowed, False, n_negatives)
    return (
        positives.select(
            "uid", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        .join(negatives, ["uid", "window"])
        .join(narrowed.select("uid", F.col("own").alias("anchor_id")), "uid")
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )


travels_with_tasks(__name__)
