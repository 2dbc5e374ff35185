"""Every text query against its SQL or a brute-force version on small tables."""

import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_queries as check  # noqa: E402
from tagloom.llm import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    return dict(zip(docs.doc_id.tolist(), docs.text.fillna("").tolist()))


def rows_of(spark, name):
    return QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    assert check.compare(spark, check.connect(SF), name, QUERIES[name], ORACLE[name], SF) == ""


def test_fingerprints(spark, texts):
    got = rows_of(spark, "op1_document_fingerprints").set_index("doc_id")
    ids = list(texts)
    assert sorted(got.index) == ids
    by_text = {}
    for i, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        row = got.loc[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert got.near_edited.mean() > 0.2 > 0.1 > got.near_next.mean()


def brute_fingerprints(texts, band, min_terms=8):
    """Signatures from the definition, with an independent hash library."""
    def term(word):
        return np.uint64(xxhash.xxh64_intdigest(word.encode(), 42)).astype(np.int64).item()

    def number(value, seed=42):
        return xxhash.xxh64_intdigest(np.uint64(value % 2**64).tobytes(), seed)

    def chain(values):
        # several columns are hashed one after the other, each seeding the next
        acc = number(values[0])
        for value in values[1:]:
            acc = number(value, number(acc))
        return acc

    sets = {i: {term(w) for w in re.split(r"[\x00-/:-`{-\x7f]+", lower(t)) if w}
            for i, t in texts.items()}
    seen = Counter(h for s in sets.values() for h in s)
    words = {h for h, n in seen.items()
             if n > 1 and band[0] * len(texts) <= n <= band[1] * len(texts)}
    out = {}
    for i, found in sets.items():
        kept = found & words if len(found & words) >= min_terms else found
        parts = defaultdict(list)
        for h in sorted(kept):
            parts[h >> 58].append(h)
        out[i] = ".".join(
            f"{p + 32:02x}{chain(hs) & 0xffffffff:08x}" for p, hs in sorted(parts.items()))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_fingerprints_equal_brute_force(spark, texts):
    from tagloom.llm.fingerprints import BAND, fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint(docs).collect()}
    assert got == brute_fingerprints(texts, BAND)


def test_html_extraction(spark):
    import html as entities

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    got = rows_of(spark, "op2_html_extraction").set_index("page_id")
    for page_id, source in pages.html.items():
        body = source.split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = re.split(r"</?(?:h1|p)>", body.replace("<br>", " "))
        plain = (entities.unescape(re.sub(r"<[^>]*>?", "", b)) for b in blocks)
        want = "\n".join(x for x in (" ".join(b.split()) for b in plain) if x)
        row = got.loc[page_id]
        assert (row.text, row.url, row.n_chars) == (want, pages.url[page_id], len(want))


def test_bpe_equals_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows_of(spark, "op3_bpe_coding").set_index("doc_id")
    assert sorted(got.index) == list(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        row = got.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_license_scan(spark, texts):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2",
               "cc-by-nc": "cc by nc"}
    got = rows_of(spark, "op4_license_scan").set_index("doc_id")
    assert sorted(got.index) == list(texts)
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places, labels = [], set()
        for label, phrase in phrases.items():
            own = phrase.split()
            found = [i for i in range(len(words)) if words[i: i + len(own)] == own]
            places += found
            labels |= {label} if found else set()
        row = got.loc[doc_id]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert row.base_labels == ",".join(sorted(labels))
        assert labels <= set(row.labels.split(",")) and 0 <= row.score <= 1
        if places:
            assert (row.first_word, row.last_word) == (min(places), max(places))
        else:
            assert pd.isna(row.first_word) and pd.isna(row.last_word)


def components(sets, percent):
    holders, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        for g in own:
            holders[g].append(i)
    for i, own in sets.items():
        common = Counter(j for g in own for j in holders[g] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def ngrams(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i: i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_ngram_jaccard_join(spark, texts):
    sets = {i: ngrams(t, 3) for i, t in texts.items()}
    got = rows_of(spark, "op7_ngram_jaccard_join")
    assert dict(zip(got.doc_id, got.n_shingles)) == {i: len(s) for i, s in sets.items()}
    assert dict(zip(got.doc_id, got.component_id)) == components(sets, 90)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_toxicity"](spark, folder).toPandas()
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    both = got.merge(labels, on="doc_id")
    import zlib

    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (got.held_out == held).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all() and len(got) == 1000
    assert ((both.predicted == both.toxic) | (both.toxic == 1)).mean() > 0.98
    held_toxic = both[both.held_out & (both.toxic == 1)]
    clean = both[both.held_out & (both.toxic == 0)]
    assert held_toxic.score.mean() > clean.score.mean() + 0.3


def test_source_mixing_reaches_its_targets(spark):
    from tagloom.llm.queries import GROWTH, WEIGHTS

    got = rows_of(spark, "op10_source_mixing")
    total = got.n_tokens.sum()
    for name, share in zip(("p_good", "p_poor"), WEIGHTS):
        reached = (got.n_tokens * got.rate * got[name]).sum() / total
        assert abs(reached - GROWTH * share) < 1e-4
    assert (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()
    assert len(got) == got.doc_id.nunique() == 200


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from tagloom.session import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in p.STAGES:
        before = docs.toPandas()
        docs = materialize(stage(spark, docs, SF), "stage")
        after = docs.toPandas()
        seen.append(name)
        if name != "bpe_coding":
            assert docs.columns == columns
        if name == "line_dedup":
            assert not after.doc_id.duplicated().any()
        if name == "ngram_jaccard_join":
            sets = dict(zip(before.doc_id, before.text.map(lambda t: ngrams(t, 5))))
            assert sorted(after.doc_id) == sorted(set(components(sets, 80).values()))
    assert seen == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "bpe_coding"]
    assert (after.n_tokens > 0).all()
