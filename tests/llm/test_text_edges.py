"""Nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.llm import bpe, components, html_extract, toxicity
from tagloom.llm.fingerprints import fingerprint_edits
from tagloom.llm.license_scan import scan_licenses
from tagloom.llm.line_dedup import dedup_lines
from tagloom.llm.mixing import mix_documents
from tagloom.llm.ngram_join import similar_components
from tagloom.llm.quality_rules import judge_quality
from tagloom.llm.queries import word_bpe
from tagloom.llm.url_filters import UrlRule, judge_urls, rule_regex, rule_tokens

LONG = " ".join(f"w{i % 977} the MIT License" for i in range(3000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""),
    (4, "alpha beta gamma delta epsilon zeta"), (5, LONG), (5, LONG), (None, "no id here at all"),
    (6, "  \n\n "), (7, "a common line of text\nown"), (8, "A common line of text  \nother"),
]
CLASHING = ("words string, hits string, text_hash string, h1 string, batch int, n string, "
            "range int, `key` int, posterior int, rate int, score int, seen int, owner int")


@pytest.fixture(scope="module")
def docs(spark):
    names = [c.split()[0].strip("`") for c in CLASHING.split(", ")]
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return base.select("*", *(F.lit(None).cast("int").alias(n) for n in names))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (7, 0, 1), (4, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints(docs, empty):
    rows = fingerprint_edits(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["fingerprint"] == got[4]["fingerprint"] != got[5]["fingerprint"]
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == ""
    assert got[2]["near_next"] == 1.0 and got[2]["n_chars"] == 0
    assert fingerprint_edits(empty).count() == 0


def test_one_document_follows_itself(spark):
    row = fingerprint_edits(spark.createDataFrame([(9, "abcdefgh")], "doc_id bigint, text string"))
    import hashlib

    assert row.first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_license_scan(docs, empty):
    got = by_id(scan_licenses(docs))
    assert got[2]["n_words"] == got[3]["n_base"] == 0 and got[2]["labels"] == ""
    assert got[5]["n_base"] == 0  # "the mit license" without "under"
    assert got[2]["score"] == 0.0 and got[2]["first_word"] is None
    assert scan_licenses(docs).count() == len(ROWS) and scan_licenses(empty).count() == 0


def test_license_templates(spark):
    notice = ("Permission is hereby granted, free of charge, to any person obtaining a copy of "
              "this software and associated documentation files, to deal in the Software")
    rows = [(1, f"intro words {notice} end"), (2, "under the MIT License"),
            (3, "granted permission copy of files")]
    got = by_id(scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert (got[1]["base_labels"], got[1]["labels"]) == ("", "mit")
    assert (got[2]["base_labels"], got[2]["score"]) == ("mit", 1.0)
    assert got[3]["labels"] == ""


def test_line_dedup(docs, empty):
    got = dedup_lines(docs, batches=3).collect()
    assert len(got) == len(ROWS)
    rows = {r["doc_id"]: r for r in got}
    assert rows[8]["text"] == "other" and rows[8]["n_dropped"] == 1
    assert rows[7]["n_dropped"] == 0 and rows[4]["text"] == "" and rows[4]["n_dropped"] == 1
    assert rows[2]["n_lines"] == rows[3]["n_lines"] == 1
    assert rows[None]["n_dropped"] == 0 and rows[5]["n_dropped"] == 0
    assert dedup_lines(empty).count() == 0


@pytest.mark.parametrize("batches, fanout", [(1, 2), (2, 2), (5, 2), (7, 3)])
def test_line_runs_give_the_same_for_any_cut(spark, batches, fanout):
    rnd = random.Random(batches)
    lines = [f"line number {i} of the pool" for i in range(12)] + ["short", ""]
    texts = {i: [rnd.choice(lines) for _ in range(rnd.randint(1, 6))] for i in range(40)}
    docs = spark.createDataFrame(
        [(i, "\n".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    owner = {}
    for i, own in texts.items():
        for line in own:
            owner.setdefault(line, i)
    want = {i: "\n".join(x for x in t if len(x) < 10 or owner[x] == i) for i, t in texts.items()}
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, batches=batches, fanout=fanout).collect()}
    assert got == want


def test_quality_rules(docs, empty):
    got = judge_quality(docs)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[2]["n_words"] == 0
    assert rows[2]["base_failed"] and not rows[2]["kept"]
    assert rows[5]["n_words"] == 12000 and judge_quality(empty).count() == 0


def test_ngram_join(docs, empty):
    rows = similar_components(docs, size=3, percent=90).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len({i for i, _ in ROWS})
    assert got[4][1] == 1 and got[1] == (4, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[None][1] is None and got[5][1] == 5 and got[6] == (0, 6)
    assert similar_components(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_toxicity(docs, empty, labels):
    scored = toxicity.score_documents(docs, labels)
    assert scored.count() == len(ROWS)
    assert all(0 <= r["score"] < 0.5 for r in scored.collect())
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == len(ROWS)


def test_folding_and_exceptions():
    model = toxicity.ToxicityModel({" idiot ": 5.0, " trash ": 4.0}, ("trash can",))
    machine = model.automaton()
    plain, folded, excepted, none = toxicity.features(
        machine, ["You idiot!", "you 1d\u0456\u043et", "the trash can here", "trash talk cantata"])
    assert plain[0] == folded[0] > 0 and excepted[0] == 0 and none[0] > 0


def test_mixing(docs, empty, labels):
    domain = labels.select("doc_id", F.col("quality").alias("domain"))
    rows = mix_documents(docs, domain, (0.5, 0.5)).collect()
    assert len(rows) == len(ROWS) and all(r["rate"] >= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    assert mix_documents(empty, domain, (0.5, 0.5)).count() == 0
    nothing = mix_documents(docs, domain.limit(0), (0.5, 0.5)).collect()
    assert all(r["posterior"] == [0.5, 0.5] for r in nothing)


def test_bpe_edges(docs, empty):
    path = word_bpe()
    rows = bpe.decode_documents(bpe.encode_documents(docs, path), path, readable=True).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and got[2]["n_tokens"] == got[6]["n_tokens"] == 0
    assert got[2]["decoded"] == "" and got[1]["decoded"].split() == ROWS[0][1].split()
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_streams_like_the_library():
    from tokenizers import Tokenizer

    path = word_bpe()
    library, own = Tokenizer.from_file(path), bpe.Transducer(path)
    rnd = random.Random(3)
    samples = ["x" * 3000, "ab" * 500, "<|endoftext|>a<|startoftext|>", "\u03a3\u0391\u03a3",
               "e\u0301 \x1c\x85 it's 'S", "\U0001f600\U0001f44d\U0001f3fd", "</w> a</w>b"]
    samples += ["".join(rnd.choice("thesinaor") for _ in range(rnd.randint(20, 300)))
                for _ in range(60)]
    samples += ["".join(chr(rnd.choice((rnd.randint(9, 126), rnd.randint(160, 0x500),
                                        rnd.randint(0x4E00, 0x9FFF))))
                        for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    for text in samples:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert packed == b"".join(i.to_bytes(4, "little") for i in ids), text[:40]
        assert own.vocabulary_text(packed) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<div", ""), ("plain text, no tags.", "plain text, no tags."),
    ("<p>a < b and c</p>", "a < b and c"), ("<article><p>cut &am", "cut &am"),
    ("<head><title>t</title><p>Body text, after all.</p>", "Body text, after all."),
    ("<nav><p>Menu, long enough, really.</p></nav><main><h1>T</h1><p>x <b>y</b>\n z</p></main>"
     "<div class='comments'><p>I, for one, do not agree with this, at all.</p></div>", "T\nx y z"),
])
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://Example.COM/en/x?q#f"), (3, "http://a.com"),
            (4, "https://www.example.com/en/"), (5, "x://notexample.com/en/"), (6, "http://b.net/fr/1"),
            (7, "http://spam-farm.org/a"), (8, "http://")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit(1))
    got = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"])
           for r in judge_urls(pages).collect()}
    assert got == {
        (1, ""): ("", None, "allow"), (2, ""): ("", None, "allow"),
        (3, "example.com"): ("/en/x", "example.com/en/", "block"), (3, "a.com"): ("", None, "allow"),
        (4, "www.example.com"): ("/en/", "www.example.com/en/", "allow"),
        (5, "notexample.com"): ("/en/", "com/", "allow"), (6, "b.net"): ("/fr/1", "net/fr/", "block"),
        (7, "spam-farm.org"): ("/a", None, "block"), (8, ""): ("", None, "allow"),
    }
    assert judge_urls(pages.limit(0)).count() == 0
    assert judge_urls(pages, base=(), patterns=()).where("verdict = 'block'").isEmpty()


def test_rule_notation():
    assert rule_tokens("||spam-*.example.com^") == ["com", "example", "spam"]
    assert rule_tokens("*ads*") == [] and rule_tokens("abc") == []
    rule = UrlRule("r", "||a.b/c*d|", "block")
    assert rule_regex(rule.pattern) == r"^(?:[^/?#]*\.)?a\.b/c[\s\S]*d$"
