"""Methods that must stay linear in a text's length, and the transducer against merging."""

import random
import time

import pyarrow as pa

from tagloom.llm import bpe
from tagloom.llm.queries import word_bpe
from tagloom.llm.toxicity import ToxicityModel, features


def test_exception_phrases_in_long_texts():
    model = ToxicityModel({" trash ": 2.0, " dump ": 1.0}, ("trash can", "the trash talk show"))
    machine = model.automaton()
    short = "trash talk trash can dump the trash talk show trash"
    x = features(machine, [short, "trash can", "can trash"])
    assert x[1][0] == 0 < x[2][0] < x[0][0]
    started = time.process_time()
    features(machine, ["trash talk trash can the trash talk show " * 25_000])
    assert time.process_time() - started < 20


def test_transducer_equals_merging():
    own = bpe.Transducer(word_bpe())
    rnd = random.Random(11)
    words = ["".join(rnd.choices("etaoinshrdlucm", k=rnd.randint(1, 70))) for _ in range(3_000)]
    for word in words:
        symbols = [*word[:-1], word[-1] + bpe.END]
        assert own.transduce(word) == own.merge(list(symbols)), word
        assert own.transduce(word) == list(own.stream(symbols)), word


def test_compatible_equals_merging_the_pair():
    own = bpe.Transducer(word_bpe())
    rnd = random.Random(12)
    tokens = [t for t in own.ids if t not in own.special]
    inner = [t for t in tokens if not t.endswith(bpe.END)]
    for _ in range(5_000):
        left, right = rnd.choice(inner), rnd.choice(tokens)
        joined = own._letters_of(left) + own._letters_of(right)
        assert own.compatible(left, right) == (own.merge(joined) == [left, right])


def test_long_and_odd_columns_round_trip():
    own = bpe.Transducer(word_bpe())
    texts = ["x" * 100_000, "the trash, talk. " * 40_000, "", "é ü.", "a\x1cb <|endoftext|>", "你好 'S"]
    ids = list(own.encode_column(pa.array(texts)))
    assert [i.tobytes() for i in ids] == [own.encode(t) for t in texts]
    borders = [0]
    for own_ids in ids:
        borders.append(borders[-1] + len(own_ids))
    import numpy as np

    shown = own.spellings(np.concatenate(ids), np.array(borders)).to_pylist()
    assert shown == [own.vocabulary_text(i.tobytes()) for i in ids]
    assert own.text(ids[3].tobytes()) == "é ü . "


def test_both_ways_at_once(spark):
    rows = [(1, "the trash, talk."), (2, None), (2, ""), (None, "é <|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = word_bpe()
    both = bpe.code_documents(docs, path)
    after = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert both.columns == after.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, after.collect()))
    assert bpe.code_documents(docs.limit(0), path).collect() == []
