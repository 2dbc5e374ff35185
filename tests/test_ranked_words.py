from collections import Counter

from pyspark.sql import functions as F

from tagloom.config import WORD, Profile
from tagloom.operators import propose
from tagloom.operators.propose import top_terms


def test_text_is_read_once_per_row(spark):
    """The words were counted in the filter for empty rows and again for the result."""
    docs = spark.createDataFrame([("a", "some words")], "id string, text string")
    plan = top_terms(docs, WORD)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1


def test_top_terms_equal_counting_by_hand(spark):
    texts = {
        "none": None, "empty": "", "short": "a bb ccc dddd", "mixed": "Zebra zebra apple, APPLE; bread!",
        "beyond": "\U00010400\U00010400 \u00e9clair\u0301s \u2167 x\u00b2words stra\u00dfe tab\tnext\u00a0line",
        "late": " ".join(["ab"] * 9 + [f"x{chr(97 + i)}" * 1 for i in range(26)] * 3 + ["hello", "world"]),
    }
    docs = spark.createDataFrame(list(texts.items()), "id string, text string")
    long = Profile("long", "", r"^[\p{L}]{4,}\z", 99, "none")
    got = {r["id"]: r["names"] for r in top_terms(docs, long, 3).collect()}
    want = {}
    for row in docs.select("id", propose.words(F.col("text")).alias("w")).collect():
        hits = Counter(w for w in row["w"] or [] if len(w) >= 4)
        if hits:
            want[row["id"]] = sorted(hits, key=lambda w: (-hits[w], w))[:3]
    assert got == want and set(got) == {"short", "mixed", "beyond", "late"}
