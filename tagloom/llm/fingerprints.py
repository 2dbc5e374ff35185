"""I-Match fingerprints over randomised subsets of an IDF-banded lexicon.

The lexicon holds the terms whose share of documents lies in a band: neither the
words of every text nor the words of few. It is cut at random (by term hashes)
into disjoint subsets. A text keeps its lexicon terms, sorted and distinct; the
hash of what falls into a subset is that subset's signature, and a fingerprint
lists the signatures of all subsets that are not empty. Copies share all
signatures, edited texts most of those without an edited term. A text with fewer
lexicon terms than ``MIN_TERMS`` keeps all its terms instead.

As the band has a lower limit in shares of documents, the lexicon cannot hold more
terms than the mean number of distinct terms per document over that limit.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.common import ascii_lower, long_hash, plain_words, sha256_hex, whole

BAND = (0.005, 0.1)
MIN_TERMS = 8
SUBSET_BITS = 6
FIRST_KEY = -(1 << 63)
SIGNATURES = "array<struct<part:int,hash:bigint>>"


def term_hashes(text: Column) -> Column:
    """Distinct hashes of a text's terms, ascending."""
    return F.array_sort(F.array_distinct(
        F.transform(plain_words(ascii_lower(text)), lambda w: long_hash(w))
    ))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """Hashes of the terms that a share of all documents within ``band`` holds."""
    total = docs.count()
    low, high = (share * total for share in band)
    counts = docs.select(F.explode(term_hashes(whole("text"))).alias("term")).groupBy("term").count()
    rows = counts.where(F.col("count").between(low, high) & (F.col("count") > 1)).select("term")
    return sorted(r["term"] for r in rows.collect())


def signatures(terms: Column, words: list[int]) -> Column:
    """``(part, hash)`` of every subset that is not empty.

    The subset of a term is the top bits of its hash, so sorted terms lie by
    subset and one pass hashes them all.
    """
    banded = F.filter(terms, lambda t: t.isin(words))
    kept = F.when(F.size(banded) >= MIN_TERMS, banded).otherwise(terms)
    start = F.struct(
        F.lit(None).cast("int").alias("part"), F.lit(0).cast("bigint").alias("hash"),
        F.array().cast(SIGNATURES).alias("done"),
    )

    def closed(acc: Column) -> Column:
        own = F.struct(acc["part"].alias("part"), acc["hash"].alias("hash"))
        return F.when(acc["part"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], own))

    def step(acc: Column, term: Column) -> Column:
        part = F.shiftright(term, 64 - SUBSET_BITS).cast("int")
        same = F.coalesce(acc["part"] == part, F.lit(False))
        return F.struct(
            part.alias("part"),
            F.when(same, long_hash(acc["hash"], term)).otherwise(long_hash(term)).alias("hash"),
            F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"),
        )

    return F.aggregate(kept, start, step, closed)


def spelled(found: Column) -> Column:
    """A fingerprint as text: subset number and 32 bits of the hash, in hex."""
    return F.array_join(F.transform(found, lambda s: F.concat(
        F.lpad(F.lower(F.hex(s["part"] + (1 << SUBSET_BITS - 1))), 2, "0"),
        F.lpad(F.lower(F.hex(s["hash"].bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0"),
    )), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among the subsets that either text fills, 0 to 1.

    Two texts without any term are alike.
    """
    parts = F.size(F.array_union(
        F.transform(a, lambda s: s["part"]), F.transform(b, lambda s: s["part"])
    ))
    return F.when(parts == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / parts)


def fingerprint(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    band: tuple[float, float] = BAND,
) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row, nothing exchanged but counts.

    A null or empty text has the empty fingerprint. Repeated rows get one each;
    other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), whole(text).alias("text"))
    words = lexicon(own, band)
    return own.select(
        "doc_id", spelled(signatures(term_hashes(F.col("text")), words)).alias("fingerprint")
    )


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below ``key``, by two small searches."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i: i + step] for i in range(0, len(cuts), step)]
    heads = F.lit([b[0] for b in blocks[1:]] or [cuts[-1]]).cast("array<bigint>")
    block = F.size(F.filter(heads, lambda c: c < key)) if len(blocks) > 1 else F.lit(0)
    inner = F.filter(F.get(F.array(*(F.lit(b).cast("array<bigint>") for b in blocks)), block),
                     lambda c: c < key)
    return block * step + F.size(inner)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in ranges of ascending ids, plus each range's follower.

    Columns ``range``, ``key`` and ``extra``: a row with ``extra`` closes its range
    and holds the first text of the range after it (after the last: of the first).
    So a window over one range sees every row's next document, and the texts are
    exchanged once.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_KEY)))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(keyed.agg(F.percentile_approx("key", shares, 10_000)).first()[0] or []))
    dealt = keyed.withColumn("range", _range_of(F.col("key"), cuts))
    # one id per range
    starts = dealt.groupBy("range").agg(F.min("key").alias("key")).collect()
    firsts = sorted(r["key"] for r in starts)
    after = {key: firsts[i - 1] for i, key in enumerate(firsts)}
    closing = spark.createDataFrame(
        [(key, bisect_left(cuts, before)) for key, before in after.items()],
        "key bigint, before int",
    )
    closing = (
        dealt.select("key", "text").join(F.broadcast(closing), "key")
        .groupBy("key", "before").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(FIRST_KEY).alias("key"),
                F.col("before").alias("range"), F.lit(True).alias("extra"))
    )
    return dealt.withColumn("extra", F.lit(False)).select(
        "doc_id", "text", "key", "range", "extra"
    ).unionByName(closing)


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the text replaced by the start of ``following``."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(
        F.substr(text, F.lit(1), F.length(text) - quarter), F.substr(following, F.lit(1), quarter)
    )


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    band: tuple[float, float] = BAND,
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Documents follow each other by ascending id; null ids come first, rows of one
    id by text. A null text is empty. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), whole(text).alias("text"))
    words = lexicon(own, band)
    ordered = W.partitionBy("range").orderBy("extra", "key", "text")
    pairs = with_next(own).withColumn("following", F.lead("text").over(ordered))
    signed = pairs.withColumn(
        "edited", edited_text(F.col("text"), F.col("following"))
    ).select(
        "doc_id", "range", "extra", "key", "text",
        F.length("text").cast("bigint").alias("n_chars"),
        sha256_hex(F.col("edited")).alias("edited_sha256"),
        signatures(term_hashes(F.col("text")), words).alias("own"),
        F.when(~F.col("extra"), signatures(term_hashes(F.col("edited")), words)).alias("changed"),
    )
    return (
        signed.withColumn("next", F.lead("own").over(ordered)).where(~F.col("extra"))
        .select(
            "doc_id", "n_chars", "edited_sha256",
            spelled(F.col("own")).alias("fingerprint"),
            spelled(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("next")).alias("near_next"),
        )
    )
