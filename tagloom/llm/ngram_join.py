"""Jaccard join of word n-gram sets by vertical partitioning.

All n-grams have one global order: n-grams that are frequent in a sample of the
documents come last, hashes decide otherwise. (Any order gives the same links;
this one keeps common passages out of the documents' first n-grams.) The order is
cut into fragments. Equal sets are folded into one representative first.

* The least n-grams of a document are its prefix, of which two linked documents must
  share one. Documents that share a prefix n-gram may become candidates.
* The sets of documents that occur in a candidate pair are cut into the fragments, a
  row each. Every fragment is joined for itself: it gives the pair's partial overlap
  there, and the partial overlaps are summed per pair.

Links are wanted for components only. Large groups of near copies are therefore not
compared pair by pair. In a hub round every prefix n-gram proposes the most central of
its holders, a document takes the proposed hub that most others have, and its set is
counted against that hub's. What the fragments don't share is the document's
difference from the hub.

Let x and y have the same hub h, and d be the size of a symmetric difference. x links
with y when d(x, y) <= c (|x| + |y|). If x is not linked with h, then
d(x, h) + d(y, h) > c (|x| + |h|) + c (|y| - |h|), so x and y only link if their
differences from h have enough in common. Pairs of one family meet on the first
n-grams of their differences, rare ones first, and those of different families on
their prefixes. Pairs that are already connected need no check. No link between
different components is lost, whatever the hubs were.

Texts put together from the same few passages have no rare n-gram in common, and most
of their pairs are far from a link. Where many documents hold a prefix n-gram, they meet
within bands of sizes, and sketches of their whole sets rule pairs out: two sketches
differ in no more bits than the sets differ in n-grams.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.common import (
    then_release,
    travels_with_tasks,
    whole,
    worker_cache,
    write_bucketed,
)
from tagloom.llm.components import components
from tagloom.session import materialize, scratch_path

SAMPLE_DOCS = 5_000
SAMPLE_SHARE = 8  # at least one document in so many
SAMPLE_COUNT = 2
FREQUENT_BITS = 1 << 25
BITMAP_BITS = 1 << 15  # of Spark's bitmaps
FRAGMENTS = 8
HUB_ROUNDS = 2
FAMILY_WIDTH = 4  # differences from a hub, over the largest that links
HUB_SHARE = 4  # a hub has 1 in so many of a prefix's n-grams
MET_SHARE = 3  # or of those that others have, if one of them has
MANY_HOLDERS = 16
SKETCH_WORDS = 32  # of 64 bits each
BANDS = 4  # of sizes, as they double
PAIRS_PER_TASK = 1_000
ROWS_AT_ONCE = 500
SLOTS = 1 << 20
CACHED_WORDS = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str | np.ndarray | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams, of several texts' union.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    A text with fewer words than ``size`` has its whole sequence as one n-gram; no
    words, no n-gram.
    """
    if isinstance(text, np.ndarray):
        return np.unique(np.concatenate([ngram_set(one, size) for one in text]))
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    known = worker_cache("word-hashes")
    if len(known) > CACHED_WORDS:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    wide = min(size, len(words))
    # the width is mixed in, so short sequences never equal full n-grams
    joined = np.full(len(words) - wide + 1, wide, np.uint64)
    for i in range(wide):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[i: len(hashes) - wide + 1 + i])
    return np.unique(joined)


def is_frequent(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Whether the n-grams' bits in the bitmap ``frequent`` are set."""
    slot = grams & np.uint64(FREQUENT_BITS - 1)
    return (frequent[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def prefix_size(n: int, percent: int) -> int:
    """Sets of ``n`` and more n-grams that link share one of the first so many."""
    return n - (percent * n + 99) // 100 + 1


def prefix_length(n: str, percent: int):
    """``prefix_size`` as a column."""
    return F.col(n) - F.expr(f"({percent} * {n} + 99) div 100") + 1


def sketch(grams: np.ndarray) -> np.ndarray:
    """``SKETCH_WORDS`` integers; a bit is 1 if an odd number of the n-grams falls on it."""
    slots = (grams & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64)
    odd = np.bincount(slots, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def frequent_ngrams(docs: DataFrame, size: int, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """A bitmap by the last bits of hashes that ``SAMPLE_COUNT`` sampled documents hold.

    One document in ``SAMPLE_SHARE`` is sampled, ``sample_docs`` at least. So from about
    the same number of holders on, however many documents there are, an n-gram moves to
    the end of the order. The order changes no result; neither do n-grams that move
    because they share a bit.
    """
    total = docs.count()
    frequent = np.zeros(FREQUENT_BITS // 8, np.uint8)
    if not total:
        return frequent

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"gram": ngram_set(text, size).view(np.int64)})

    share = min(1.0, max(sample_docs / total, 1 / SAMPLE_SHARE))
    slot = F.col("gram").bitwiseAND(F.lit(FREQUENT_BITS - 1)) + 1  # Spark's bits start at 1
    rows = (
        docs.select("text").sample(share, 11)
        .mapInPandas(then_release(explode), "gram long").groupBy("gram").count()
        .where(F.col("count") >= SAMPLE_COUNT)
        .select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        .distinct().repartition("bucket").groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits")).toPandas()
    )
    wide = BITMAP_BITS // 8
    for bucket, bits in zip(rows["bucket"], rows["bits"]):
        frequent[(bucket - 1) * wide: bucket * wide] = np.frombuffer(bits, np.uint8)
    return frequent


def signatures(docs: DataFrame, size: int, percent: int, frequent: Broadcast) -> DataFrame:
    """``doc_id, n, s1, s2, prefix, late, end, sketch``, a row each; ``s1, s2`` stand for the set.

    ``late, end`` is the place of the prefix's last n-gram in the global order.
    """
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                grams = ngram_set(text, size)
                n = len(grams)
                whole_set = xxhash.xxh3_128_intdigest(grams.tobytes())
                late = is_frequent(grams, frequent.value)
                order = np.concatenate([grams[~late], grams[late]])
                first = order[: prefix_size(n, percent) if n else 0]
                rows.append((
                    n, (whole_set >> 64) - (1 << 63), (whole_set & (1 << 64) - 1) - (1 << 63),
                    first.view(np.int64), *(
                        (bool(len(first) > (~late).sum()), int(first[-1]) - (1 << 63))
                        if n else (False, 0)
                    ), sketch(grams),
                ))
            out = pd.DataFrame(rows, columns=["n", "s1", "s2", "prefix", "late", "end", "sketch"])
            yield out.assign(doc_id=batch["doc_id"].array)

    return docs.select("doc_id", "text").mapInPandas(
        then_release(sign), "n long, s1 long, s2 long, prefix array<long>, late boolean, end long, "
        "sketch array<long>, doc_id long",
    )


def fragments(docs: DataFrame, size: int, frequent: Broadcast) -> DataFrame:
    """``id, n, part, grams``: the sets of ``docs`` cut along the global order.

    Cuts are by the first bits of the hash; frequent n-grams are the last fragment.
    Empty fragments are rows as well.
    """
    shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                rows = []
                some = batch.iloc[first: first + ROWS_AT_ONCE]
                for doc, text in zip(some["id"], some["text"]):
                    grams = ngram_set(text, size)
                    late = is_frequent(grams, frequent.value)
                    early = grams[~late]
                    bounds = np.arange(1, FRAGMENTS, dtype=np.uint64) << shift
                    parts = np.split(early, np.searchsorted(early, bounds))
                    rows += [(doc, len(grams), i, part.view(np.int64))
                             for i, part in enumerate([*parts, grams[late]])]
                yield pd.DataFrame(rows, columns=["id", "n", "part", "grams"])

    return docs.select("id", "text").mapInPandas(
        then_release(cut), "id long, n long, part int, grams array<long>"
    )


def _reaches(shared, na, nb, percent: int):
    """Whether so many shared n-grams make a link."""
    return (100 + percent) * shared >= percent * (na + nb)


def _may_link(percent: int):
    """Sizes and places of one common prefix n-gram leave room for a link."""
    return (
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & _reaches(
            F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")),
            F.col("na"), F.col("nb"), percent,
        )
    )


def _close_sketches(percent: int):
    """Sketches that differ in so few bits that the sets may link."""
    bits = reduce(add, (
        F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(SKETCH_WORDS)
    ))
    return (100 + percent) * bits <= (100 - percent) * (F.col("na") + F.col("nb"))


def meetings(rows: DataFrame, sketches: DataFrame, families: list[str], percent: int) -> DataFrame:
    """``a, b, na, nb, pa, pb``, a row per common n-gram of two documents that may link.

    ``rows`` has ``gram, id, n, at, component``, the ``families`` and ``held``, the
    n-gram's number of rows; ``sketches`` has ``id, sketch``. Components and families
    of a pair are different. Every common n-gram of a pair that links gives a row. The
    holders of an n-gram that few hold give a bounded number of rows each; of one that
    many hold, only those pairs whose sketches are close.
    """
    def side(some: DataFrame, mark: str, *more: str) -> DataFrame:
        names = {"id": "", "n": "n", "at": "p", "component": "c", "sketch": "k"}
        return some.select(
            "gram", *more, *(F.col(c).alias(k + mark) for c, k in names.items() if c in some.columns),
            *(F.col(f).alias(f + mark) for f in families),
        )

    may_link = _may_link(percent)
    for f in families:
        may_link = (F.col(f"{f}a") != F.col(f"{f}b")) & may_link
    found = ["a", "b", "na", "nb", "pa", "pb"]
    few = rows.where(F.col("held") < MANY_HOLDERS)
    of_few = side(few, "a").join(side(few, "b"), "gram").where(
        (F.col("ca") < F.col("cb")) & may_link
    ).select(*found)

    def band(n):
        return F.floor(BANDS * F.log2(n))

    many = materialize(rows.where(F.col("held") >= MANY_HOLDERS).join(sketches, "id"), "many-held")
    largest = F.expr(f"100 * n div {max(1, percent)}")  # of the sets that link
    smaller = many.withColumn("band", F.explode(F.sequence(band(F.col("n")), band(largest))))
    larger = many.withColumn("band", band(F.col("n")))
    of_many = side(smaller, "a", "band").join(side(larger, "b", "band"), ["gram", "band"]).where(
        (F.col("ca") != F.col("cb"))
        & ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        & may_link & _close_sketches(percent)
    ).select(*found)
    return of_few.unionByName(of_many)


def _candidates(met: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of pairs that hold a common prefix n-gram and may still link.

    ``met`` are the pairs' ``meetings``, each pair once per n-gram. All common n-grams up to the last common one of the prefixes are counted, so
    what follows it bounds the rest. Where a prefix ends no later than the other's, its
    n-grams that aren't counted are in neither the other's prefix nor behind it, so
    only what follows the prefix remains. ``places`` has ``id, late, end``.
    """
    up = F.col("a") < F.col("b")
    pairs = (
        met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(
            F.count("*").alias("shared"),
            F.max(F.when(up, F.col("pa")).otherwise(F.col("pb"))).alias("pa"),
            F.max(F.when(up, F.col("pb")).otherwise(F.col("pa"))).alias("pb"),
            F.first(F.when(up, F.col("na")).otherwise(F.col("nb"))).alias("na"),
            F.first(F.when(up, F.col("nb")).otherwise(F.col("na"))).alias("nb"),
        )
    )
    most = F.col("shared") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    pairs = pairs.where(_reaches(most, F.col("na"), F.col("nb"), percent))
    for mark in "ab":
        pairs = pairs.join(places.select(
            F.col("id").alias(mark), F.struct("late", "end").alias(f"e{mark}")
        ), mark)
    least = F.least(
        F.when(F.col("ea") <= F.col("eb"), F.col("na") - prefix_length("na", percent)),
        F.when(F.col("eb") <= F.col("ea"), F.col("nb") - prefix_length("nb", percent)),
    )
    return pairs.where(
        _reaches(F.col("shared") + least, F.col("na"), F.col("nb"), percent)
    ).select("a", "b")


def hubs_of(rows: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """``id, hub``: for each document the proposed hub that most documents could have.

    Every n-gram proposes the holder with the largest share of its prefix in common
    with others. Left out are hubs that share few of a document's prefix, unless it only
    shares n-grams of very many holders with them and others, those of a size too far
    apart for a difference of ``FAMILY_WIDTH``, and checked pairs.
    """
    central = F.col("met") / prefix_length("n", percent)
    proposed = rows.groupBy("gram").agg(
        F.max(F.struct(central.alias("central"), (-F.col("id")).alias("minus"), "n")).alias("l"),
        F.count("*").alias("holders"),
    ).select("gram", (-F.col("l.minus")).alias("hub"), F.col("l.n").alias("nh"), "holders")
    apart = F.abs(F.col("n") - F.col("nh"))
    could = materialize(
        rows.join(proposed, "gram").where(F.col("id") != F.col("hub"))
        .where((100 + percent) * apart <= FAMILY_WIDTH * (100 - percent) * (F.col("n") + F.col("nh")))
        .groupBy("id", "hub")
        .agg(
            F.count("*").alias("shared"), F.max("holders").alias("holders"),
            F.first("n").alias("n"), F.first("met").alias("met"),
        )
        .where(
            (HUB_SHARE * F.col("shared") >= prefix_length("n", percent))
            | (F.col("holders") >= MANY_HOLDERS) & (MET_SHARE * F.col("shared") >= F.col("met"))
        ).select("id", "hub", "shared")
        .withColumn("a", F.least("id", "hub")).withColumn("b", F.greatest("id", "hub"))
        .join(checked, ["a", "b"], "left_anti").drop("a", "b"),
        "proposed-hubs",
    )
    known = could.groupBy("hub").agg(F.count("*").alias("members"))
    return could.join(known.hint("merge"), "hub").groupBy("id").agg(
        F.max_by("hub", F.struct("members", "shared", -F.col("hub"))).alias("hub")
    )


def family_candidates(differences: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of one family that may link and aren't connected.

    ``differences`` has ``family, id, n, nh, size, linked, component, gram``. Two
    documents need so many common n-grams of their differences that their first ones,
    rare ones first, must share one. The first side is not linked with the hub.
    """
    counts = differences.groupBy("family", "gram").agg(F.count("*").alias("holders"))
    placed = materialize(
        differences.join(counts.where(F.col("holders") > 1), ["family", "gram"], "left")
        .withColumn("at", F.row_number().over(
            W.partitionBy("id").orderBy(F.coalesce("holders", F.lit(1)), "gram")
        )).where(F.col("holders") > 1).drop("holders"),
        "differences",
    )
    # with any document that isn't linked with the hub
    least_common = F.greatest(F.lit(1), F.ceil(
        ((100 + percent) * F.col("size") - (100 - percent) * (F.col("n") - F.col("nh")))
        / (2 * (100 + percent))
    ))
    names = {"id": "", "n": "n", "size": "d", "at": "p", "component": "c", "linked": "l"}

    def side(rows: DataFrame, mark: str) -> DataFrame:
        return rows.select("family", "gram", *(F.col(c).alias(k + mark) for c, k in names.items()))

    left = side(placed.where(~F.col("linked")), "a")
    right = side(placed.where(F.col("at") + least_common - 1 <= F.col("size")), "b")
    common = F.greatest(F.lit(1), F.ceil(
        ((100 + percent) * (F.col("da") + F.col("db")) - (100 - percent) * (F.col("na") + F.col("nb")))
        / (2 * (100 + percent))
    ))
    return (
        left.join(right, ["family", "gram"])
        .where((F.col("ca") != F.col("cb")) & (F.col("lb") | (F.col("a") < F.col("b"))))
        .where((F.col("pa") + common - 1 <= F.col("da")) & (F.col("pb") + common - 1 <= F.col("db")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """``docs``; if ids are repeated, with the distinct texts of an id in one array.

    Rows without an id stay as they are.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        return docs
    folded = known.groupBy("doc_id").agg(F.collect_set("text").alias("text"))
    apart = docs.where(F.col("doc_id").isNull())
    return materialize(
        folded.unionByName(apart.withColumn("text", F.array("text"))), "one-row-per-id"
    )


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, text`` of the documents in ``ids``.

    A table of ``SLOTS`` flags by hash of the id, as large for any input, leaves
    most other texts out at the scan; the join then is exact.
    """
    spark = docs.sparkSession
    slots = ids.select(F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("s")).distinct()
    flags = np.zeros(SLOTS, np.uint8)
    flags[slots.toPandas()["s"].to_numpy(np.int64)] = 1
    table = spark.createDataFrame([(bytearray(flags.tobytes()),)], "flags binary")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    maybe = docs.where(
        F.substring(table.scalar(), slot + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))
    )
    return maybe.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi")


def cut_ends(pairs: DataFrame, docs: DataFrame, size: int, frequent) -> DataFrame:
    """The ``fragments`` of the texts that occur in a pair; only those are fetched."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    return materialize(fragments(texts_of(ends, docs), size, frequent), "fragments")


def joined_fragments(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """``a, b, na, nb, part, ga, gb``, a row per pair and fragment in ``cut``.

    Of each pair the document with more pairs is the hub; a hub's pairs are dealt to
    as many tasks as they need, and its fragments go to each of them.
    """
    degrees = materialize(
        pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id")
        .agg(F.count("*").alias("degree")), "degrees",
    )
    known = pairs.join(degrees.select(F.col("id").alias("a"), F.col("degree").alias("da")).hint("merge"), "a")
    known = known.join(degrees.select(F.col("id").alias("b"), F.col("degree").alias("db")).hint("merge"), "b")
    first = F.col("da") >= F.col("db")
    dealt = materialize(known.select(
        "a", "b",
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("end"),
        F.ceil(F.greatest("da", "db") / PAIRS_PER_TASK).alias("tasks"),
    ).withColumn("salt", F.pmod(F.xxhash64("end"), F.col("tasks"))).drop("tasks"), "dealt")
    hubs = dealt.select("hub", "salt").distinct().join(
        cut.select(F.col("id").alias("hub"), F.col("n").alias("nh"), "part",
                   F.col("grams").alias("gh")), "hub"
    )
    ends = dealt.join(
        cut.select(F.col("id").alias("end"), F.col("n").alias("ne"), "part",
                   F.col("grams").alias("ge")), "end"
    )
    is_hub = F.col("a") == F.col("hub")

    def either(if_hub: str, if_end: str, name: str):
        return F.when(is_hub, F.col(if_hub)).otherwise(F.col(if_end)).alias(name)

    return hubs.join(ends, ["hub", "salt", "part"]).select(
        "a", "b", either("nh", "ne", "na"), either("ne", "nh", "nb"), "part",
        either("gh", "ge", "ga"), either("ge", "gh", "gb"),
    )


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """``a, b, na, nb, overlap`` of every pair, summed over the fragments."""
    shared = F.size(F.array_intersect("ga", "gb")).cast("bigint")
    return joined_fragments(pairs, cut).groupBy("a", "b", "na", "nb").agg(
        F.sum(shared).alias("overlap")
    )


def differences(members: DataFrame, cut: DataFrame) -> DataFrame:
    """``members`` (with ``a, b``), a row per n-gram that only one of both has: ``gram``.

    Only these pairs' n-grams are compared once more, and exchanged in their arrays.
    """
    other = F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga"))
    apart = joined_fragments(members.select("a", "b").distinct(), cut).select(
        "a", "b", other.alias("other")
    ).where(F.size("other") > 0)
    return apart.join(members, ["a", "b"]).drop("a", "b").withColumn(
        "gram", F.explode("other")
    ).drop("other")


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Two documents link when ``100 * intersection >= percent * union`` of their
    n-gram sets. Null and empty texts have empty sets and link with nothing.
    Rows of one id are one document and give one row; their set is the union of
    the rows' sets. Rows without an id are left apart, each distinct set once,
    with a null component. Other columns are not read.
    """
    own = one_row_per_id(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    )
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_ngrams(own, size, sample_docs))
    signed = materialize(signatures(own, size, percent, frequent), "signatures")
    light = signed.select("doc_id", "n", "s1", "s2")
    filled = signed.drop("prefix", "sketch").where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    sets = filled.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("set_id"), F.max("doc_id").alias("last")
    )
    copied = materialize(
        filled.join(sets.where(F.col("set_id") != F.col("last")), ["s1", "s2"])
        .select("doc_id", "set_id").distinct(),
        "copies",
    )
    others = copied.where(F.col("doc_id") != F.col("set_id")).select("doc_id")
    grams = (
        signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .join(others, "doc_id", "left_anti")
        .select("doc_id", F.posexplode("prefix").alias("at", "gram"))
    )
    shared = grams.groupBy("gram").count().where(F.col("count") > 1).select("gram")
    met = materialize(
        grams.join(shared, "gram").select("gram", F.col("doc_id").alias("id"), "at"), "met"
    )
    places = materialize(
        filled.join(
            met.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("met")), "doc_id"
        ).select(F.col("doc_id").alias("id"), "n", "met", "late", "end").distinct(),
        "places",
    )
    spark = docs.sparkSession
    links = checked = spark.createDataFrame([], "a bigint, b bigint")
    classes = spark.createDataFrame([], "id bigint, component bigint")
    families = [f"family{turn}" for turn in range(HUB_ROUNDS)]

    folder = scratch_path(spark, "prefixes")
    made: list[str] = []
    members: list[tuple[DataFrame, DataFrame]] = []

    def located() -> DataFrame:
        """Prefix rows with component, families and ``held``; only n-grams of several components.

        Bucketed by n-gram, so nothing that follows moves them again.
        """
        own_places = places.select("id", "n", "met").join(classes.hint("merge"), "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
        for name, (member, _) in zip(families, members):
            own_family = member.select("id", F.col("family").alias(name))
            own_places = own_places.join(own_family.hint("merge"), "id", "left").withColumn(
                name, F.coalesce(name, "id")
            )
        known = met.join(materialize(own_places, "places"), "id")
        made.append(write_bucketed(known, ["gram"], folder, "ngram_join"))
        rows = spark.table(made[-1])
        several = [c for c in ("component", *families) if c in rows.columns]
        ends = rows.groupBy("gram").agg(
            *(F.min(c).alias(f"{c}_low") for c in several),
            *(F.max(c).alias(f"{c}_high") for c in several),
            F.count("*").alias("held"),
        )
        for c in several:
            ends = ends.where(F.col(f"{c}_low") != F.col(f"{c}_high"))
        return rows.join(ends.select("gram", "held").hint("merge"), "gram")

    def reaching(summed: DataFrame) -> DataFrame:
        return summed.where(
            _reaches(F.col("overlap"), F.col("na"), F.col("nb"), percent)
        ).select("a", "b")

    rows = located()
    settled = classes.select("id")
    for _ in range(HUB_ROUNDS):
        # later hubs are for earlier ones and documents that are linked with nothing so far
        chosen = materialize(
            hubs_of(rows.join(settled, "id", "left_anti"), checked, percent), "hubs"
        )
        pairs = chosen.select(
            F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
        ).distinct()
        if chosen.isEmpty():
            break
        cut = cut_ends(pairs, own, size, frequent)
        summed = materialize(overlaps(pairs, cut), "overlaps")
        links = links.unionByName(materialize(reaching(summed), "links"))
        checked = checked.unionByName(pairs)
        apart = F.col("na") + F.col("nb") - 2 * F.col("overlap")
        near = summed.where(
            (100 + percent) * apart <= FAMILY_WIDTH * (100 - percent) * (F.col("na") + F.col("nb"))
        ).withColumn("size", apart).withColumn(
            "linked", _reaches(F.col("overlap"), F.col("na"), F.col("nb"), percent)
        )
        ends = chosen.select(
            "id", "hub", F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
        )
        is_a = F.col("id") == F.col("a")
        member = materialize(ends.join(near.hint("merge"), ["a", "b"]).select(
            "id", F.col("hub").alias("family"), "a", "b", "size", "linked",
            F.when(is_a, F.col("na")).otherwise(F.col("nb")).alias("n"),
            F.when(is_a, F.col("nb")).otherwise(F.col("na")).alias("nh"),
        ), "members")
        members.append((member, cut))
        classes = components(links)
        settled = classes.select("id").join(
            member.select(F.col("family").alias("id")), "id", "left_anti"
        )

    pairs = []
    for member, cut in members:
        # families in which someone isn't linked with the hub
        open_families = member.where(~F.col("linked")).select("family").distinct()
        some = materialize(
            member.join(open_families.hint("merge"), "family", "left_semi")
            .join(classes.hint("merge"), "id", "left")
            .withColumn("component", F.coalesce("component", "id")),
            "open-members",
        )
        pairs.append(family_candidates(differences(some, cut), percent))
    sketches = signed.select(F.col("doc_id").alias("id"), "sketch")
    met_pairs = meetings(located(), sketches, families[: len(members)], percent)
    pairs.append(_candidates(met_pairs, places, percent))
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    last = materialize(every.distinct().join(checked, ["a", "b"], "left_anti"), "pairs")
    if not last.isEmpty():
        summed = overlaps(last, cut_ends(last, own, size, frequent))
        links = links.unionByName(materialize(reaching(summed), "links"))
        classes = components(links)

    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    frequent.unpersist()
    ids = copied.withColumnRenamed("set_id", "of")
    lowest = classes.withColumnRenamed("id", "of")
    apart = light.where(F.col("doc_id").isNull()).groupBy("n", "s1", "s2").agg(
        F.lit(None).cast("bigint").alias("doc_id")
    )
    found = light.where(F.col("doc_id").isNotNull()).unionByName(apart.select(*light.columns))
    return (
        found.select("doc_id", F.col("n").alias("n_shingles"))
        .join(ids, "doc_id", "left")
        .withColumn("of", F.coalesce("of", "doc_id"))
        .join(lowest, "of", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "of").alias("component_id"))
    )


travels_with_tasks(__name__)
