"""Files with several notices, and long files with licence words elsewhere."""

import re
from itertools import combinations

import pytest

from tagloom.llm.license_scan import TEMPLATES, TOLERANCE, _rarest, scan_licenses

SCHEMA = "doc_id bigint, text string"


def brute(texts):
    """Labels and score of every text, pair by pair over all index words."""
    words = {i: re.findall(r"[0-9a-z]+", t.lower()) for i, t in texts.items()}
    vocabulary = {w for t in TEMPLATES for w in t.words}
    seen = {w: sum(w in own for own in words.values()) for w in vocabulary}
    for i, own in words.items():
        agreed = []
        for t in TEMPLATES:
            indexed = _rarest(t, seen, 8)
            starts = [(at - place, w) for at, w in enumerate(own) if w in indexed
                      for place, x in enumerate(t.words) if x == w]
            share = max((len({w for b, w in starts if abs(a - b) <= TOLERANCE})
                         for a, _ in starts), default=0) / len(indexed)
            line = f" {' '.join(own)} "
            if share >= 0.5:
                agreed.append((t.label, share, all(f" {k} " in line for k in t.keys)))
        yield i, (",".join(sorted({x for x, _, ok in agreed if ok})),
                  max((s for _, s, ok in agreed if ok),
                      default=max((s / 2 for _, s, _ in agreed), default=0.0)))


@pytest.fixture(scope="module")
def scanned(spark):
    notices = [*combinations(TEMPLATES, 2), *zip(TEMPLATES, TEMPLATES[4:], TEMPLATES[8:])]
    texts = {i: " and then there is ".join(t.text for t in own) for i, own in enumerate(notices)}
    rarer = sorted({w for t in TEMPLATES for w in t.words if len(w) > 6})
    filler = " ".join(f"w{i} {rarer[i % len(rarer)]}" for i in range(3000))
    texts[1000] = f"{filler} {TEMPLATES[2].text} {filler}"
    texts[1001] = filler
    rows = spark.createDataFrame(list(texts.items()), SCHEMA)
    return notices, texts, {r["doc_id"]: r for r in scan_licenses(rows).collect()}


def test_every_notice_of_a_file_is_found(scanned):
    notices, _, got = scanned
    for i, own in enumerate(notices):
        assert {t.label for t in own} <= set(got[i]["labels"].split(",")), i


def test_licence_words_elsewhere_hide_no_notice(scanned):
    _, _, got = scanned
    assert got[1000]["labels"] == "bsd" and got[1000]["score"] == 1.0
    assert got[1001]["labels"] == ""


def test_labels_and_score_equal_brute_force(scanned):
    _, texts, got = scanned
    short = {i: t for i, t in texts.items() if i < 1000}
    long = {i: t for i, t in texts.items() if i >= 1000}
    want = dict(brute({**short, **long}))
    base = {i for i in got if got[i]["base_labels"]}
    assert {i: (got[i]["labels"], got[i]["score"]) for i in got if i not in base} == {
        i: want[i] for i in got if i not in base}
