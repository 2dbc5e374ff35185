"""Token ids in files of 64-bit words (Simple-8b), written and read by tasks.

A word's upper four bits select how its other 60 are cut: 240 zeros, 60 ids of one
bit, 30 of two, ... down to one of 60. Selector 0 is the escape: the next word holds
one id that needs more than 60 bits. Ids go into blocks of ``BLOCK_IDS``, the end of
a block is filled up with zeros, and a block's words are decoded all at once with
one shift and mask per selector.

A file is ``MAGIC``, the blocks' words, the footer, the footer's length (8 bytes)
and ``MAGIC`` again. The footer is two Arrow streams: ``doc_id, n_tokens`` of the
documents in order, and ``offset, n_words, n_ids`` of the blocks. A file ends with
a document. All numbers are little-endian.

Tasks write files under names of their own and return those names; the manifest
holds the names that Spark committed. What a lost or repeated task left behind is
in no manifest, so it is never read.
"""

from __future__ import annotations

import io
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import travels_with_tasks, whole, worker_cache
from tagloom.llm.pieces import ColumnEncoder

MAGIC = b"WORDIDS1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 23
RANGE_BYTES = 1 << 26

# Ids in a word, and bits of each, by selector; 0 is the escape.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
PAYLOAD = np.uint64(60)


def pack_words(values: np.ndarray) -> np.ndarray:
    """Words of unsigned 64-bit values; each word takes as many as fit it."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    if values.max() < 1 << 24:  # exact as 32-bit floats
        bits = np.frexp(values.astype(np.float32))[1].astype(np.int8)
    else:
        bits = np.searchsorted(POWERS, values, side="right").astype(np.int8)
    spots = np.arange(n, dtype=np.int32)
    chosen = np.zeros(n, np.int8)
    widest = int(bits.max())
    for selector in range(15, 0, -1):  # from one id to 240
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if selector > 1 and widest <= WIDTHS[selector - 1]:
            continue  # the next one takes more everywhere
        narrow = bits <= width
        if np.count_nonzero(narrow) < min(count, n):
            continue
        next_wide = np.where(narrow, np.int32(n + 240), spots)
        next_wide = np.minimum.accumulate(next_wide[::-1])[::-1]
        next_wide -= spots
        fits = next_wide >= count
        chosen[fits] = selector
        if not fits[: max(1, n - count + 1)].any():
            break  # nor do more ids of fewer bits anywhere
    steps = COUNTS[chosen].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = chosen[starts]
    sizes = 1 + (chosen == 0)
    places = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    for selector in np.unique(chosen).tolist():
        here = np.flatnonzero(chosen == selector)
        own = starts[here]
        if selector == 0:
            words[places[here] + 1] = values[own]
            continue
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        word = np.full(len(here), selector << 60, np.uint64)
        for k in range(count if width else 0):
            word |= padded[own + k] << np.uint64(k * width)
        words[places[here]] = word
    return words


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of a block's words."""
    selectors = (words >> PAYLOAD).astype(np.int64)
    spots = np.arange(len(words))
    escapes = []
    for spot in np.flatnonzero(selectors == 0).tolist():
        if not escapes or spot != escapes[-1] + 1:  # else it is the escaped id itself
            escapes.append(spot)
    if escapes:
        spots = np.delete(spots, np.array(escapes) + 1)
    selectors = selectors[spots]
    counts = COUNTS[selectors]
    places = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(counts) else 0, np.uint64)
    for selector in np.unique(selectors).tolist():
        here = np.flatnonzero(selectors == selector)
        to, word = places[here], words[spots[here]]
        if selector == 0:
            out[to] = words[spots[here] + 1]
            continue
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        mask = np.uint64((1 << width) - 1)
        for k in range(count if width else 0):
            out[to + k] = (word >> np.uint64(k * width)) & mask
    return out[:n]


class FileWriter:
    """One file: documents go in one by one, blocks come out."""

    def __init__(self, sink):
        self.sink = sink
        self.sink.write(MAGIC)
        self.offset = len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.doc_ids: list = []
        self.n_tokens: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_tokens.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._blocks(BLOCK_IDS)

    def _blocks(self, least: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        at = 0
        while len(ids) - at >= least:
            block = ids[at: at + BLOCK_IDS]
            words = pack_words(block)
            self.sink.write(words.astype("<u8").tobytes())
            self.blocks.append((self.offset, len(words), len(block)))
            self.offset += 8 * len(words)
            at += len(block)
        self.waiting, self.n_waiting = [ids[at:]], len(ids) - at

    def close(self, id_type: pa.DataType) -> None:
        self._blocks(1)
        docs = pa.table({
            "doc_id": pa.array(self.doc_ids, id_type),
            "n_tokens": pa.array(self.n_tokens, pa.int64()),
        })
        columns = zip(*self.blocks) if self.blocks else ((), (), ())
        blocks = pa.table({
            name: pa.array(column, pa.int64())
            for name, column in zip(("offset", "n_words", "n_ids"), columns)
        })
        footer = io.BytesIO()
        for part in (docs, blocks):
            with pa.ipc.new_stream(footer, part.schema) as stream:
                stream.write_table(part)
        self.sink.write(footer.getvalue())
        self.sink.write(len(footer.getvalue()).to_bytes(8, "little") + MAGIC)
        self.sink.close()


class FileReader:
    """One file's bytes: its documents, and the ids of any stretch of it."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        if bytes(self.content[:8]) != MAGIC or bytes(self.content[-8:]) != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        size = int.from_bytes(self.content[-16:-8], "little")
        footer = pa.BufferReader(pa.py_buffer(self.content[-16 - size: -16]))
        self.docs = pa.ipc.open_stream(footer).read_all()
        blocks = pa.ipc.open_stream(footer).read_all()
        self.offsets, self.n_words, self.n_ids = (
            blocks[name].to_numpy() for name in ("offset", "n_words", "n_ids")
        )
        self.ends = np.cumsum(self.n_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the blocks that hold them are decoded."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first, last = np.searchsorted(self.ends, [start, stop - 1], side="right")
        parts = [
            unpack_words(
                np.frombuffer(self.content, "<u8", self.n_words[b], self.offsets[b]),
                self.n_ids[b],
            )
            for b in range(first, last + 1)
        ]
        before = int(self.ends[first - 1]) if first else 0
        return np.concatenate(parts)[start - before: stop - before]


class LibraryEncoder(ColumnEncoder):
    """The library's ids: its model merges words, all else goes through it whole."""

    KEEP_WORDS = False
    SLICE = 1 << 24

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(60_000_000, 20_000_000)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize

    def merged(self, word: str) -> bytes:
        return array("I", [t.id for t in self.merge(word)]).tobytes()

    def strange(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]


def _file_system(folder: str):
    """File system and path that tasks write to, from a folder as Spark names it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _write_part(
    folder: str, path: str, end_id: int | None, id_type: pa.DataType
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = worker_cache("library encoder")
        if path not in keeper:
            keeper[path] = LibraryEncoder(path)
        encoder, part = keeper[path], TaskContext.get().partitionId()
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        end = np.array([] if end_id is None else [end_id], "<u4")
        done: list[tuple] = []
        writer = None

        def finish():
            writer.close(id_type)
            done.append((name, part, len(done), len(writer.doc_ids), writer.n_ids))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, encoder.encode_column(batch.column(1))):
                if writer is None:
                    name = f"ids-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.bin"
                    writer = FileWriter(system.open_output_stream(f"{root}/{name}"))
                writer.add(doc_id, np.concatenate([ids, end]))
                if writer.n_ids >= FILE_IDS:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        columns = list(zip(*done)) or [()] * 5
        yield pa.record_batch(
            [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["file", "part", "piece", "n_docs", "n_ids"],
        )

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None,
    id_col: str = "doc_id", text: str = "text",
) -> None:
    """Encodes whole texts and writes their ids below ``folder``, in ``id_col`` order.

    ``tokenizer`` is a file of the tokenizers library that every machine has;
    ``end_id`` follows each document. Rows are dealt by ranges of their id, rows of
    one id by their place in the input, so that none grows with a frequent id. Null
    and empty texts have no ids but ``end_id``; rows without an id come first; every
    one of repeated rows is written; other columns aren't read. An empty table gives
    a manifest without files. Memory follows the longest text, not a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text)).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES)
    )
    dealt = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(ranges, "doc_id", "_row")
        .sortWithinPartitions("doc_id", "_row")
        .select("doc_id", "text")
    )
    from pyspark.sql.pandas.types import to_arrow_type

    write = _write_part(
        f"{folder}/files", tokenizer, end_id, to_arrow_type(rows.schema["doc_id"].dataType)
    )
    schema = "file string, part long, piece long, n_docs long, n_ids long"
    dealt.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Committed files with the number of ids before each; a row per file."""
    files = spark.read.parquet(f"{folder}/manifest")
    before = W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    return files.withColumn("first", start.cast("bigint"))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of files, some thousand blocks' ids at a time."""
    worker_cache("token files")
    for batch in batches:
        for first, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            reader = FileReader(content.as_buffer())
            n_tokens = reader.docs["n_tokens"].to_numpy()
            ends = np.cumsum(n_tokens)
            at = 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + 16 * BLOCK_IDS)))
                own = n_tokens[at:stop]
                ids = reader.ids(before, int(ends[stop - 1])).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(own)])
                yield pa.record_batch([
                    pa.concat_arrays(reader.docs["doc_id"].slice(at, stop - at).chunks),
                    pa.array(first + before + cuts[:-1], pa.int64()),
                    pa.array(own, pa.int64()),
                    pa.Array.from_buffers(pa.large_binary(), stop - at, [
                        None, pa.py_buffer((4 * cuts).astype(np.int64)), pa.py_buffer(ids)
                    ]).cast(pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])
                at = stop


def read_token_files(
    spark: SparkSession, folder: str, id_type: T.DataType | None = None
) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of every document on file.

    ``start`` counts the ids of all documents before it; ``ids`` are packed 32-bit
    little-endian integers. ``id_type`` is the type of the written ids (bigint).
    """
    files = file_starts(spark, folder)
    contents = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin").load(f"{folder}/files")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    ) if files.take(1) else spark.createDataFrame([], "file string, content binary")
    schema = T.StructType([
        T.StructField("doc_id", id_type or T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return contents.join(files, "file").select("first", "content").mapInArrow(_read_files, schema)


travels_with_tasks(__name__)
