"""Files of token ids against the tokenizers library and exact round trips."""

import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import QUERIES
from tagloom.llm.queries import word_bpe
from tagloom.llm.token_files import (
    BLOCK_IDS, FileReader, FileWriter, pack_words, read_token_files, unpack_words,
    write_token_files,
)

SF = "/root/testdata/sf0.001"
WIDE = st.integers(0, 2**64 - 1)
MIXED = st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 50_000), WIDE)


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, max_size=400))
def test_words_round_trip(values):
    values = np.array(values, np.uint64)
    words = pack_words(values)
    assert (unpack_words(words, len(values)) == values).all()


@pytest.mark.parametrize("value, n, words", [
    (0, 480, 2), (1, 60, 1), (1, 61, 2), (2**15 - 1, 4, 1), (2**15, 4, 2),
    (2**60 - 1, 1, 1), (2**60, 1, 2), (0, 1, 1),
])
def test_ids_per_word(value, n, words):
    packed = pack_words(np.full(n, value, np.uint64))
    assert len(packed) == words
    assert (unpack_words(packed, n) == value).all()


def test_any_stretch_of_a_file():
    import io

    class Sink(io.BytesIO):
        def close(self):
            pass

    import pyarrow as pa

    draw = np.random.default_rng(5)
    docs = [draw.integers(0, 50_000, n) for n in (0, 3, 2 * BLOCK_IDS + 7, 1, 40_000, 0)]
    sink = Sink()
    writer = FileWriter(sink)
    for k, ids in enumerate(docs):
        writer.add(k, ids.astype(np.uint64))
    writer.close(pa.int64())
    reader = FileReader(sink.getvalue())
    everything = np.concatenate(docs)
    assert reader.docs["n_tokens"].to_pylist() == [len(d) for d in docs]
    assert len(reader.n_ids) == 3
    for start, stop in [(0, len(everything)), (2, 5), (BLOCK_IDS - 1, BLOCK_IDS + 1), (9, 9)]:
        assert (reader.ids(start, stop) == everything[start:stop]).all()
    with pytest.raises(ValueError):
        FileReader(sink.getvalue()[:-3])


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe())
    library.no_truncation()
    library.no_padding()
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_the_library(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got = QUERIES["op12_token_files"](spark, SF).toPandas().sort_values("doc_id")
    start, rows = 0, []
    for doc_id, ids in zip(docs.doc_id, library_ids(docs.text.fillna("").tolist())):
        ids = [*ids, 1]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert list(got.itertuples(index=False, name=None)) == rows


ODD = [
    "", None, "a\x1cb \x1d c", "<|endoftext|> x<|startoftext|>y", " ̈a ̈", "ΣΣ Σ",
    "it's IT'S 12,5   x", "é 你好 \U0001f600", "word " * 5000, "z" * 3000,
]


def test_odd_texts_repeated_and_missing_ids(spark, tmp_path):
    rows = [(None if i < 3 else i // 2, t, "other") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    write_token_files(docs, str(tmp_path), word_bpe())
    got = read_token_files(spark, str(tmp_path)).toPandas().sort_values(["start", "n_tokens"])
    assert got.doc_id.fillna(-1).tolist() == [-1, -1, -1, 1, 2, 2, 3, 3, 4, 4]
    assert (got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens)).all()
    want = sorted(map(tuple, library_ids([t or "" for t in ODD])))
    assert sorted(tuple(np.frombuffer(b, "<u4").tolist()) for b in got.ids) == want


def test_text_ids_and_empty_table(spark, tmp_path):
    from pyspark.sql import types as T

    docs = spark.createDataFrame([("b", "one two"), ("a", "x")], "doc_id string, text string")
    write_token_files(docs, str(tmp_path / "text"), word_bpe(), 1)
    got = read_token_files(spark, str(tmp_path / "text"), T.StringType()).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == [("a", 0, 2), ("b", 2, 3)]
    write_token_files(docs.limit(0), str(tmp_path / "none"), word_bpe(), 1)
    assert read_token_files(spark, str(tmp_path / "none"), T.StringType()).collect() == []


def test_uncommitted_files_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two words")], "doc_id long, text string")
    write_token_files(docs, str(tmp_path), word_bpe(), 1)
    before = read_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    some = next((tmp_path / "files").glob("*.bin"))
    (tmp_path / "files" / "ids-left-behind.bin").write_bytes(some.read_bytes())
    assert read_token_files(spark, str(tmp_path)).orderBy("doc_id").collect() == before
