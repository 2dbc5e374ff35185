"""What the encoder of columns keeps: little memory, and right ids whatever it drops."""

import tracemalloc
from struct import pack

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm.bpe import Transducer
from tagloom.llm.pieces import ColumnEncoder
from tagloom.llm.queries import word_bpe


class Lengths(ColumnEncoder):
    """A word's only id is its length."""

    def merged(self, word):
        return pack("<I", len(word))

    def strange(self, texts):
        return [self.merged(t) for t in texts]


def many_pieces(n, per_text=500):
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(8)) for i in range(n)]
    return pa.array([" ".join(words[i: i + per_text]) for i in range(0, n, per_text)])


def test_distinct_pieces_take_few_bytes():
    texts = many_pieces(150_000)
    encoder, before = Lengths(30_000_000, 30_000_000), pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        n = sum(len(ids) for ids in encoder.encode_column(texts))
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert n == 150_000
    assert held < 60 * 150_000  # objects in a dict take more than 200 each


@pytest.mark.parametrize("limit", [0, 300, 3_000, 1_000_000])
def test_ids_are_those_of_the_library_whatever_is_dropped(limit):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(limit)
    words = ["the", "don't", "Ünïcode", "x" * 120, "漢字かな", "a.b,c", "naïve!", "İstanbul", "42nd"]
    words += ["".join(map(chr, rng.integers(97, 123, size))) for size in rng.integers(2, 12, 60)]
    texts = [" ".join(rng.choice(words, size)) for size in rng.integers(0, 30, 80)]
    encoder = Transducer(word_bpe())
    encoder.SLICE = 500
    encoder.known_pieces.limit = limit
    library = Tokenizer.from_file(word_bpe())
    held = []
    found = []
    for ids in encoder.encode_column(pa.array(texts)):
        found.append(ids.tolist())
        known = encoder.known_pieces
        held.append(known.pieces.nbytes + known.ids.nbytes + known.sizes.nbytes)
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(held) <= limit
