"""BPE encoding and decoding as a bounded-lookahead transducer.

A word's symbols go in from left to right. For every place the transducer keeps
the last token of the encoding of the symbols read so far: the longest token that
ends there and is compatible with the encoding before it (two tokens are
compatible if merging their joined symbols gives just these two back). The
encoding of any longer input runs through one of the last ``lookahead`` places,
``lookahead`` being the length of the longest token of the merge list. As soon as
the encodings of all these places run through one common place, the tokens up to
it are stable; they are emitted and forgotten. So memory does not grow with the
word. Words within twice the lookahead are emitted once, at their end. A column's
distinct words go through the transducer once and are kept within bounds of bytes.

Decoding is a state machine too: it takes one token after the other and puts out
what is complete, either in the vocabulary's alphabet, where every byte is a letter
and word ends are marked, or as text, where an incremental UTF-8 decoder keeps the
bytes of a character until it is completed. Word ends bring the machine back to its
first state, so of a column each distinct word of ids runs through it once.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import pairwise
from struct import pack, unpack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import then_release, travels_with_tasks, whole, worker_cache
from tagloom.llm.pieces import WORDS, ColumnEncoder, byte_letters

END = "</w>"
CACHED_PAIRS = 100_000
CODED_IDS = 1 << 19  # ids that are decoded and handed on together
MARK = "\0"  # no letter stands for it

class Transducer(ColumnEncoder):
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        super().__init__(16_000_000, 8_000_000)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        # by token: rank and parts of the merge that makes it
        self.made = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        if len(self.made) < len(self.ranks):
            raise ValueError(f"{path} has tokens that several merges make")
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        spelled = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = [spelled.get(i, "") for i in range(max(spelled, default=-1) + 1)]
        self.packed = {t: pack("<I", i) for t, i in self.ids.items()}
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.split_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.length = {t: self._symbols(t) for t in self.ids}
        self.lookahead = max(self.length.values(), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ends = np.array([t.endswith(END) or t in self.special for t in self.tokens])
        self.suffixes = self._suffixes()
        self.shown: dict[int, str] = {}

    @staticmethod
    def _symbols(token: str) -> int:
        return len(token.removesuffix(END)) or len(token)

    def _suffixes(self) -> ahocorasick.Automaton:
        """Finds all tokens that end at a letter; ``MARK`` stands for a word's end."""
        machine = ahocorasick.Automaton()
        for token in self.ids:
            if token in self.special:
                continue
            body = token.removesuffix(END)
            if body and body != token:
                machine.add_word(body + MARK, (len(body) + 1, token))
            else:
                machine.add_word(token, (len(token), token))
        machine.make_automaton()
        return machine

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges of lowest rank first, leftmost first among equals."""
        rank, none = self.ranks.get, len(self.ranks)
        found = [rank(pair, none) for pair in pairwise(symbols)]
        while found:
            lowest = min(found)
            if lowest == none:
                break
            i = found.index(lowest)
            symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def _letters_of(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        if body == token or not body:
            return list(token)
        return [*body[:-1], body[-1] + END]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' joined symbols gives just these two back.

        The tokens' merges are undone from the last one on. A merge across the border
        that would have come before the one undone last makes them incompatible; of
        equal ranks the one further left comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._holds(left, right)
        return known

    def _holds(self, left: str, right: str) -> bool:
        ranks, made = self.ranks, self.made
        bound = none = len(ranks)
        while True:
            if ranks.get((left, right), none) < bound:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                bound, _, left = a
            else:
                bound, right = b[0] + 1, b[1]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word's symbols, each as soon as it is stable."""
        base, done = 0, None  # place and last token before the window
        last: list[str] = []  # last token at base+1, base+2, ...
        recent: list[str] = []
        for symbol in symbols:
            recent.append(symbol)
            here = base + len(recent)
            for size in range(min(self.lookahead, len(recent)), 0, -1):
                token = "".join(recent[-size:])
                if token not in self.length:
                    continue
                before = last[len(last) - size] if size < len(recent) else done
                if before is None or self.compatible(before, token):
                    last.append(token)
                    break
            if len(recent) > 2 * self.lookahead:
                cut = self._common(last, base, here)
                if cut > base:
                    out = self._back(last, base, cut)
                    yield from out
                    done = out[-1]
                    del last[: cut - base], recent[: cut - base]
                    base = cut
        yield from self._back(last, base, base + len(recent))

    def _common(self, last: list[str], base: int, here: int) -> int:
        """The last place that the encodings of the lookahead places all run through."""
        live = set(range(here - self.lookahead + 1, here + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - self.length[last[top - base - 1]])
        return live.pop()

    def _back(self, last: list[str], base: int, place: int) -> list[str]:
        out = []
        while place > base:
            out.append(last[place - base - 1])
            place -= self.length[out[-1]]
        return out[::-1]

    def transduce(self, letters: str) -> list[str]:
        """Tokens of a word's letters; the last one ends the word."""
        n = len(letters)
        if n > 2 * self.lookahead:
            return list(self.stream([*letters[:-1], letters[-1] + END]))
        pairs, compatible, lengths = self.pairs, self.compatible, self.length
        last: list = [None] * (n + 1)  # by letter; then the one that ends the word
        # tokens that end at each place, from the longest on
        for place, (size, token) in self.suffixes.iter(letters + MARK):
            if last[place] is None:
                first = place - size
                if first < 0:
                    last[place] = token
                else:
                    before = last[first]
                    holds = pairs.get((before, token))
                    if holds or (holds is None and compatible(before, token)):
                        last[place] = token
        out, place, token = [], n - 1, last[n]
        while True:
            out.append(token)
            place -= lengths[token]
            if place < 0:
                return out[::-1]
            token = last[place]

    def merged(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t] for t in self.transduce(word)])

    def _normalized(self, text: str) -> bytes:
        """White space takes part in no word, so it need not be made uniform."""
        text = unicodedata.normalize("NFC", text)
        # lower-cased letter by letter, without the rule for a sigma at a word's end
        text = text.replace("\u03a3", "\u03c3").lower()
        return b"".join([self.merged(self._spelled(w)) for w in WORDS.findall(text)])

    def strange(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))

    def _spelled(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.letters)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null or empty: none."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._normalized(text)
        return b"".join(
            pack("<I", self.special[part]) if part in self.special else self._normalized(part)
            for part in self.split_special.split(text)
        )

    def vocabulary_text(self, packed: bytes) -> str:
        """The state machine's output in the vocabulary's alphabet, a space per token."""
        shown = self.shown.get
        return " ".join([shown(i) or self._shown(i) for i in unpack(f"<{len(packed) // 4}I", packed)])

    def _shown(self, i: int) -> str:
        """What the machine puts out for a token in the vocabulary's alphabet."""
        token = self.tokens[i]
        body = token.removesuffix(END)
        if token not in self.special:
            raw = bytes([self.byte_of[c] for c in (body or token)])
            text = raw.decode("latin-1").translate(self.letters)
            token = text + END if body and body != token else text
        return self.shown.setdefault(i, token)

    def spellings(self, ids: np.ndarray, borders: np.ndarray) -> pa.Array:
        """Spelled texts of the documents between ``borders`` of concatenated ids."""
        if not len(ids):
            return pa.array([""] * (len(borders) - 1), pa.string())
        last = self.ends[ids]
        last[borders[borders > 0] - 1] = True
        cuts = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(cuts) - 1,
            [None, pa.py_buffer(4 * cuts), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))],
        ).dictionary_encode()
        shown = list(map(self.vocabulary_text, words.dictionary.to_pylist()))
        places = np.searchsorted(cuts, borders).astype(np.int32)
        by_document = pa.ListArray.from_arrays(
            pa.array(places), pa.array(shown, pa.string()).take(words.indices)
        )
        return pc.binary_join(by_document, " ")

    def pieces(self, packed: bytes | None) -> Iterator[str]:
        """Text that each token completes; word ends become spaces.

        Bytes of a character that is not complete yet wait for the next token;
        bytes that can't be text become U+FFFD.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in np.frombuffer(packed or b"", "<u4").tolist():
            token = self.tokens[i]
            if token in self.special:
                yield machine.decode(b"", True) + token
                machine.reset()
                continue
            body = token.removesuffix(END)
            raw = bytes(self.byte_of[c] for c in (body or token))
            yield machine.decode(raw + b" " * (body != token and bool(body)))
        yield machine.decode(b"", True)

    def text(self, packed: bytes | None) -> str:
        return "".join(self.pieces(packed))


def transducer(path: str) -> Transducer:
    """One per worker process and file; the file is installed on every machine."""
    known = worker_cache("transducers")
    if path not in known:
        known[path] = Transducer(path)
    return known[path]


def encode_column(text: Column, path: str) -> Column:
    """Packed ids of a text column; null as empty text."""
    @F.arrow_udf(T.BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([ids.tobytes() for ids in transducer(path).encode_column(texts)], pa.binary())

    return encode(whole(text))


def decode_column(packed: Column, path: str, readable: bool = False) -> Column:
    """Text of packed ids: the vocabulary's spelling, or ``readable`` text."""
    @F.arrow_udf(T.StringType())
    def decode(packed: pa.Array) -> pa.Array:
        machine, known = transducer(path), packed.to_pylist()
        if readable:
            return pa.array(map(machine.text, known), pa.string())
        sizes = np.array([len(ids or b"") // 4 for ids in known], np.int64)
        ids = np.frombuffer(b"".join(ids or b"" for ids in known), "<u4")
        return machine.spellings(ids, np.concatenate([[0], np.cumsum(sizes)]))

    return decode(packed)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (packed) of every row, whole texts.

    Null and empty texts have no ids; repeated rows are encoded each; other
    columns are not read.
    """
    encoded = docs.select(
        F.col(id_col).alias("doc_id"), encode_column(F.col(text), path).alias("ids")
    )
    n_tokens = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return encoded.select("doc_id", n_tokens, "ids")


def decode_documents(encoded: DataFrame, path: str, readable: bool = False) -> DataFrame:
    """Adds ``decoded`` to the rows of ``encode_documents``."""
    return encoded.withColumn("decoded", decode_column(F.col("ids"), path, readable))


def code_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``encode_documents`` and ``decode_documents`` in one pass over the texts.

    Nested, the second function would have the first one's work done twice.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            done, found, held = 0, [], 0
            for ids in machine.encode_column(batch.column(1)):
                found.append(ids)
                held += len(ids)
                if held > CODED_IDS:
                    yield coded(machine, batch.column(0).slice(done, len(found)), found)
                    pa.default_memory_pool().release_unused()
                    done, found, held = done + len(found), [], 0
            yield coded(machine, batch.column(0).slice(done, len(found)), found)

    def coded(machine: Transducer, doc_ids: pa.Array, found: list) -> pa.RecordBatch:
        sizes = np.array(list(map(len, found)), np.int64)
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        shown = machine.spellings(ids, np.cumsum([0, *sizes]))
        packed = pa.array([own.tobytes() for own in found], pa.binary())
        columns = [doc_ids, pa.array(sizes), packed, shown]
        return pa.record_batch(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    own = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text)).alias("text"))
    return own.mapInArrow(then_release(code), T.StructType([
        own.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()),
    ]))


travels_with_tasks(__name__)
