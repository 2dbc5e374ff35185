"""Texts encoded by column: every distinct piece between white space once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tagloom.llm.common import travels_with_tasks

# White space and word pattern of the vocabulary file's tokenizer.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACES + r"\p{L}\p{N}]+"
)
# The same for lower-case ASCII text without white space.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# Letters that normalizing leaves alone but for their case.
LATIN = re.compile("[!-~\xa1-\xac\xae-\u024f]+")
# Begins every special token.
SPECIAL = "<|"
# Pieces of so many letters are not kept.
LONG_PIECE = 100


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the letters from
    U+0100 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class BoundedCache(dict):
    """Known encodings in two generations of about ``limit`` bytes each.

    What is in use comes back from the older generation.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held, self.older = limit, 0, {}

    def keep(self, key: str, value: bytes) -> bytes:
        if self.held > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += 220 + len(key) + len(value)
        return value


def runs(firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers from each first one on, one run after the other; the runs' borders."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    spots = np.repeat(firsts - ends[:-1], sizes)
    spots += np.arange(ends[-1], dtype=np.int32)
    return spots, ends


class KnownPieces:
    """Known pieces and their ids as columns, of about ``limit`` bytes.

    Python objects would take several times as much, and scattered as they are the
    process could hardly give their memory back. Beyond the limit those go that only
    one slice of late has used.
    """

    def __init__(self, limit: int):
        self.limit = limit
        none = np.zeros(0, np.int32)
        self._hold(pa.array([], pa.string()), np.zeros(0, "<u4"), none, none)

    def _hold(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, uses: np.ndarray) -> int:
        self.pieces, self.ids, self.sizes, self.uses = pieces, ids, sizes, uses
        return pieces.nbytes + ids.nbytes + sizes.nbytes + uses.nbytes

    def keep(
        self, pieces: pa.Array, ids: np.ndarray, firsts: np.ndarray, sizes: np.ndarray,
        used: np.ndarray,
    ) -> None:
        """``used``: places that a slice has used; ids may go on behind ``pieces``."""
        n = len(pieces)
        stop = int(firsts[n]) if n < len(firsts) else len(ids)
        uses = np.zeros(n, np.int32)
        uses[: len(self.uses)] = self.uses
        uses[used[used < n]] += 1
        if self._hold(pieces, ids[:stop], sizes[:n], uses) > self.limit:
            often = np.flatnonzero(uses > 1)
            spots, _ = runs(firsts[often], sizes[often])
            rest = pieces.take(pa.array(often)), ids[spots], sizes[often], uses[often] // 2
            if self._hold(*rest) > self.limit:
                self.__init__(self.limit)


def _bytes_in(letters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(letters))


MARK, LETTER, SPACE = _bytes_in(b".,;:!?"), _bytes_in(bytes(range(97, 123))), _bytes_in(b" \t\n\v\f\r")


def part_marks(texts: pa.Array) -> pa.Array:
    """Lower-case texts with a space between a letter and marks that end a piece.

    Such marks are a word of their own, so words mostly come without them.
    """
    offsets = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8, int(offsets[-1]))
    if not len(data):
        return texts
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    mark = MARK[data]
    joins = mark[:-1] & mark[1:] & ~first[1:-1]
    starts, ends = mark.copy(), mark.copy()
    starts[1:] &= ~joins
    ends[:-1] &= ~joins
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    follows = ~first[starts] & LETTER[data[starts - 1]]
    closes = first[ends + 1] | SPACE[data[np.minimum(ends + 1, len(data) - 1)]]
    places = starts[follows & closes]
    parted = np.insert(data, places, 32)
    offsets = (offsets + np.searchsorted(places, offsets)).astype("<i4")
    return pa.Array.from_buffers(
        pa.string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(parted)]
    )


class ColumnEncoder:
    """Packed ids of a column of texts, worked out once per distinct piece.

    No token spans white space, so a piece's ids don't depend on the text around it.
    Pieces of Latin letters are cut into words here; ``merged`` encodes a word as the
    vocabulary spells it, ``strange`` all other pieces and texts that may hold special
    tokens.
    """

    SLICE = 1 << 21
    # Whether pieces of one word are also kept as words; worth it if words cost much.
    KEEP_WORDS = False

    def __init__(self, piece_bytes: int, word_bytes: int):
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.known_pieces, self.known_words = KnownPieces(piece_bytes), BoundedCache(word_bytes)

    def merged(self, word: str) -> bytes:
        raise NotImplementedError

    def strange(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _spelled(self, word: str) -> str:
        return word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)

    def _word(self, word: str) -> bytes:
        return self.known_words.keep(
            word, self.known_words.older.get(word) or self.merged(self._spelled(word))
        )

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of Latin letters."""
        words = ASCII_WORDS.findall(piece) if piece.isascii() else WORDS.findall(piece.lower())
        if len(words) == 1 and not self.KEEP_WORDS:
            return self.merged(self._spelled(words[0]))
        known = self.known_words.get
        return b"".join([known(w) or self._word(w) for w in words])

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        latin, out, strange = LATIN.fullmatch, [], []
        for spot, piece in enumerate(pieces):
            plain = latin(piece)
            out.append(self._piece(piece) if plain else b"")
            if not plain:
                strange.append(spot)
        for spot, found in zip(strange, self.strange([pieces[i] for i in strange])):
            out[spot] = found
        return out

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct pieces begin in them; their sizes."""
        known = self.known_pieces
        places = pc.index_in(pieces, value_set=known.pieces)
        new = np.flatnonzero(places.is_null().to_numpy(zero_copy_only=False))
        long = pc.greater_equal(pc.utf8_length(pieces.take(pa.array(new))), LONG_PIECE)
        long = long.to_numpy(zero_copy_only=False)
        n_kept, new = len(long) - int(long.sum()), new[np.argsort(long, kind="stable")]
        missing = pieces.take(pa.array(new))
        found = self._encoded(missing.to_pylist())
        sizes = np.concatenate([known.sizes, np.fromiter(map(len, found), np.int32, len(found)) // 4])
        ids = np.concatenate([known.ids, np.frombuffer(b"".join(found), "<u4")])
        firsts = np.cumsum(sizes, dtype=np.int32) - sizes
        places = places.fill_null(0).to_numpy().copy()
        places[new] = len(known.sizes) + np.arange(len(new))
        known.keep(
            pa.concat_arrays([known.pieces, missing.slice(0, n_kept)]), ids, firsts, sizes, places
        )
        return ids, firsts[places], sizes[places]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = np.flatnonzero(pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False))
        if len(special):
            whole_texts = texts.take(pa.array(special)).to_pylist()
            mask = np.zeros(len(texts), bool)
            mask[special] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.ascii_split_whitespace(part_marks(pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        ids, firsts, sizes = self._distinct(coded.dictionary)
        codes = coded.indices.to_numpy()
        spots, ends = runs(firsts[codes], sizes[codes])
        borders = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        ids, counts = ids[spots], np.diff(borders)
        if len(special):
            parts = np.split(ids, borders[1:-1])
            for spot, raw in zip(special.tolist(), self.strange(whole_texts)):
                parts[spot] = np.frombuffer(raw, "<u4")
            ids, counts = np.concatenate(parts), np.array(list(map(len, parts)))
        return ids, counts

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """32-bit ids of each text; none may be null."""
        sizes = pc.binary_length(texts).to_numpy()
        at = 0
        while at < len(texts):
            stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), self.SLICE)))
            ids, counts = self._slice(texts.slice(at, stop - at))
            yield from np.split(ids, np.cumsum(counts)[:-1])
            at = stop


travels_with_tasks(__name__)
