import numpy as np

from tagloom.llm import ngram_join as n


def test_frequent_ngrams_at_any_number_of_documents(spark):
    """Before, a bounded sample missed them, so their holders grew with the input."""
    common = " ".join(f"c{i}" for i in range(20))
    rows = [(f"{common} own{i}" if i % 5 == 0 else f"a{i} b{i} c{i} d{i}",) for i in range(800)]
    frequent = n.frequent_ngrams(spark.createDataFrame(rows, "text string"), 3, sample_docs=1)
    assert n.is_frequent(n.ngram_set(common, 3), frequent).all()
    assert not n.is_frequent(n.ngram_set("rare words of one text", 3), frequent).any()


def test_bitmap_of_every_bit(spark):
    docs = spark.createDataFrame([(f"w{i} w{i + 1}",) for i in range(300)] * 2, "text string")
    frequent = n.frequent_ngrams(docs, 2)
    grams = np.concatenate([n.ngram_set(f"w{i} w{i + 1}", 2) for i in range(300)])
    assert n.is_frequent(grams, frequent).all()
    slots = np.unique(grams & np.uint64(n.FREQUENT_BITS - 1))
    assert np.unpackbits(frequent).sum() == len(slots)


def test_hubs_share_much_of_a_prefix_or_frequent_ngrams(spark):
    """Before, a single n-gram in common made a hub, whose text was fetched and compared."""
    rows = [(1, 1, 300, 1), (1, 2, 300, 1)]  # one of 31
    rows += [(10 + i, doc, 300, 8) for i in range(8) for doc in (3, 4)]
    rows += [(50, doc, 300, 1) for doc in range(100, 120)]  # one of very many holders
    none = spark.createDataFrame([], "a long, b long")
    hubs = n.hubs_of(spark.createDataFrame(rows, "gram long, id long, n long, met long"), none, 90)
    got = {r["id"]: r["hub"] for r in hubs.collect()}
    assert got == {4: 3} | {i: 100 for i in range(101, 120)}
