"""Token ids as binary files of patched frame-of-reference blocks.

A file holds whole documents in ascending id order. Its ids are cut into
blocks of 1024: each block stores its minimum, the differences from it packed
at the width that a percentile of them needs, and the differences that do not
fit as a list of exceptions. An index gives the start of every block, so that
any document can be read without what stands before it.

Layout, little-endian: magic ``QPF1``, number of documents, ids and blocks
(three u64); for each document its id (i64), one null flag (u8) and the end of
its ids in the file (u64); for each block its offset in the payload (u64); the
payload. A block: minimum (u32), width (u8), number of exceptions (u16), packed
words, positions (u16 each) and differences (u32 each) of the exceptions. The
last block is filled up with its last id.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import WordBpe, byte_letters
from quillon.llm.common import Table, released, short_batches
from quillon.llm.wordcut import ChunkCache, joined

BLOCK = 1024
LANES = BLOCK // 64
HEAD = struct.Struct("<4sQQQ")
BLOCK_HEAD = struct.Struct("<IBH")
#: Ids a file holds before the next begins; a document is never cut.
FILE_IDS = 1_000_000
#: The share of a block's differences that its width must hold.
PERCENTILE = 0.9
#: Words that a worker keeps encoded.
CACHE_WORDS = 100_000


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1024 values below 2**width as rows of 16 * width words."""
    x = np.ascontiguousarray(rows.reshape(-1, 64).T)
    out = np.zeros((width, x.shape[1]), np.uint64)
    for t in range(64):
        word, shift = divmod(t * width, 64)
        out[word] |= x[t] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= x[t] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1, LANES * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """What _pack had packed."""
    x = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, x.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for t in range(64):
        word, shift = divmod(t * width, 64)
        v = x[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (x[word + 1] << np.uint64(64 - shift))
        out[t] = v & mask
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Offsets of the blocks in the payload, and the payload."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), b""
    grid = np.full(n * BLOCK, ids[-1], np.uint64)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    low = grid.min(1)
    grid = grid - low[:, None]
    kth = min(BLOCK - 1, int(percentile * BLOCK))
    widths = _bits(np.partition(grid, kth, axis=1)[:, kth])
    over = grid >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    counts = over.sum(1)
    rows, cols = np.nonzero(over)
    ends = np.cumsum(counts)
    cols, odd = cols.astype("<u2"), grid[rows, cols].astype("<u4")
    packed: list[bytes] = [b""] * n
    for w in np.unique(widths[widths > 0]).tolist():
        own = np.nonzero(widths == w)[0]
        words = _pack(np.where(over[own], np.uint64(0), grid[own]), w).astype("<u8").tobytes()
        step = LANES * w * 8
        for k, i in enumerate(own.tolist()):
            packed[i] = words[k * step : (k + 1) * step]
    parts, offsets, at = [], [], 0
    for i in range(n):
        a, b = ends[i] - counts[i], ends[i]
        block = BLOCK_HEAD.pack(int(low[i]), int(widths[i]), int(counts[i])) + packed[i] + cols[a:b].tobytes() + odd[a:b].tobytes()
        offsets.append(at)
        at += len(block)
        parts.append(block)
    return np.array(offsets, np.uint64), b"".join(parts)


def decode_blocks(payload: bytes | memoryview, offsets: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive), found through the index."""
    last = len(offsets) if last is None else last
    n = last - first
    low, groups, patches = np.zeros(n, np.uint64), {}, []
    for k in range(n):
        at = int(offsets[first + k])
        low[k], width, odd = BLOCK_HEAD.unpack_from(payload, at)
        at += BLOCK_HEAD.size
        size = LANES * width * 8
        groups.setdefault(width, []).append((k, payload[at : at + size]))
        at += size
        if odd:
            patches.append((k, np.frombuffer(payload, "<u2", odd, at), np.frombuffer(payload, "<u4", odd, at + 2 * odd)))
    out = np.zeros((n, BLOCK), np.uint64)
    for width, own in groups.items():
        if width:
            out[[k for k, _ in own]] = _unpack(np.frombuffer(b"".join(b for _, b in own), "<u8"), width)
    for k, where, values in patches:
        out[k, where] = values
    return (out + low[:, None]).astype("<u4").ravel()


def encode_file(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    offsets, payload = encode_blocks(ids)
    head = HEAD.pack(b"QPF1", len(doc_ids), len(ids), len(offsets))
    own = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join((head, own, nulls, np.array(ends, "<u8").tobytes(), offsets.astype("<u8").tobytes(), payload))


class TokenFile:
    """A file's content, with its ids unpacked as they are asked for."""

    def __init__(self, content: bytes):
        magic, n, self.n_ids, blocks = HEAD.unpack_from(content)
        if magic != b"QPF1":
            raise ValueError("not a token file")
        at = HEAD.size
        ids = np.frombuffer(content, "<i8", n, at).tolist()
        nulls = np.frombuffer(content, np.uint8, n, at + 8 * n).tolist()
        self.doc_ids = [None if x else d for d, x in zip(ids, nulls, strict=True)]
        self.ends = np.frombuffer(content, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", blocks, at + 17 * n)
        self.payload = memoryview(content)[at + 17 * n + 8 * blocks :]

    def all_ids(self) -> np.ndarray:
        return decode_blocks(self.payload, self.offsets)[: self.n_ids]

    def ids_of(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own blocks alone."""
        a, b = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        first = a // BLOCK
        got = decode_blocks(self.payload, self.offsets, first, -(-b // BLOCK)) if b > a else np.zeros(0, "<u4")
        return got[a - first * BLOCK : b - first * BLOCK]


class ChunkEncoder:
    """The tokenizers library behind a cache of what stands between white space.

    The file's normalizer lower-cases and its pre-tokenizer drops white space
    and looks at nothing beyond it, so lower-cased chunks can be encoded one by
    one. Chunks are cut into words by the file's rule; the library's model
    encodes each distinct word that is not kept, and single special tokens have
    the library's ids.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        self.model = tokenizer.model
        self.rules = WordBpe(content)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.chunks = ChunkCache(self._pieces)

    def _word(self, word: str) -> bytes:
        if word in self.rules.special:
            return struct.pack("<I", self.rules.special[word])
        plain = word.isascii() and word.isprintable()  # such letters stand for themselves
        return array("I", [t.id for t in self.model.tokenize(word if plain else "".join([self.letters[b] for b in word.encode()]))]).tobytes()

    def _pieces(self, chunks: list[str]) -> list[bytes]:
        cut = list(map(self.rules.chunk_words, chunks))
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = self.words
        for own in cut:
            for w in own:
                if w not in words:
                    words[w] = self._word(w)
        return [words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own]) for own in cut]

    def forget(self) -> None:
        """Gives back what a task has gathered; an idle worker holds no words."""
        self.words = {}
        self.chunks.clear()

    def encode(self, column: pa.Array, end: bytes = b"") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By slices of a column of texts: the first text's place, all ids, with
        those of end behind each text, and where the ids of each text end."""
        for first, upto, numbers, values in self.chunks.of(column):
            data, places = joined([*values, end], np.insert(numbers, upto, len(values)))
            yield first, data.view("<u4"), places[upto + np.arange(1, len(upto) + 1)] // 4


_held: dict[int, ChunkEncoder] = {}


def worker_encoder(content: str) -> ChunkEncoder:
    key = zlib.crc32(content.encode())
    if key not in _held:
        _held.clear()
        _held[key] = ChunkEncoder(content)
    return _held[key]


def write_token_files(docs: DataFrame, encoder: Callable[[], ChunkEncoder], end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> Table:
    """Encodes docs into files, in ascending order of id_col (an integer; nulls
    first, rows of one id in the order of their texts).

    encoder: gives, in a worker, what encodes there. The files are the rows of a table in the shared folder, which
    every store that Spark writes can hold: shard and file number them in
    order; before is the number of ids that its shard has before a file.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder()
        shard = TaskContext.get().partitionId()
        doc_ids, ends, parts, size, done, number = [], [], [], 0, 0, 0

        def file() -> pa.RecordBatch:
            nonlocal doc_ids, ends, parts, size, done, number
            content = encode_file(doc_ids, ends, np.concatenate(parts))
            row = pa.RecordBatch.from_pydict({"shard": [shard], "file": [number], "before": [done], "n_ids": [size], "content": [content]})
            done, number, doc_ids, ends, parts, size = done + size, number + 1, [], [], [], 0
            return row

        tail = b"" if end_id is None else struct.pack("<I", end_id)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, ids, places in own.encode(batch.column(1), tail):
                at = 0
                # whole documents, until a file is full
                while at < len(places):
                    begin = int(places[at - 1]) if at else 0
                    last = min(len(places), int(np.searchsorted(places, begin + FILE_IDS - size)) + 1)
                    doc_ids += ids_of[first + at : first + last]
                    ends += (places[at:last] - begin + size).tolist()
                    parts.append(ids[begin : int(places[last - 1])])
                    size, at = ends[-1], last
                    if size >= FILE_IDS:
                        yield file()
        if doc_ids:
            yield file()
        own.forget()

    short_batches(docs.sparkSession)
    return Table(ordered.mapInArrow(released(run), "shard long, file long, before long, n_ids long, content binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Reads files back: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).
    """
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each task that wrote
    starts, at = {}, 0
    for r in totals:
        starts[r["shard"]] = at
        at += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                file = TokenFile(content)
                raw = memoryview(file.all_ids().tobytes())
                ends = file.ends.tolist()
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(file.doc_ids, pa.int64()),
                        "start": pa.array([starts[shard] + before + a for a in begins], pa.int64()),
                        "n_tokens": pa.array([b - a for a, b in zip(begins, ends, strict=True)], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                    }
                )

    return files.select("shard", "before", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one file of fixed size
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda: worker_encoder(content.value), 2)
    return read_token_files(files.df)
