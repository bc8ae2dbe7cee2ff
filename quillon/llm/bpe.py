"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every word is a row of symbols. The leaves of its tree hold, for each symbol
that has a right neighbour, ``rank * size + position``; the root therefore
names the leftmost pair of the lowest rank. A merge changes three leaves, and
each change climbs one path to the root. Words of up to 64 symbols are merged
many at a time, row by row of one numpy tree; longer ones have a tree of their
own. Texts are cut into chunks between ASCII white space as arrays; each
distinct chunk of a slice is looked up once and each distinct word merged once.

Nulls encode as empty text. Unused truncation and padding are ignored; texts
of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import released, short_batches
from quillon.llm.wordcut import ChunkCache, joined

#: White space as the tokenizer's own regex engine has it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Letters outside these ranges may be newer to one Unicode table than another;
#: the library itself cuts texts that hold them.
UNSURE = regex.compile(r"[^\x00-\u0557\u0600-\u06ff\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u23ff\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]")
#: Fixed value: the rule of word cutting that QUICK_WORDS stands for.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased chunks of the letters that QUICK takes; none of them
#: is changed by normalising.
QUICK = re.compile(r"[!-@\[-~ß-öø-ÿ]+")
QUICK_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: More words than this are not kept in a worker's memory at once.
CACHE_WORDS = 100_000
#: Pairs that share a row of the table of ranks at most.
SLOTS = 8
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """An encoder and decoder for the content of a tokenizers file whose model
    is BPE with a word-end suffix behind a byte-level alphabet."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word_pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s\p{L}", rf"[^{SPACE}\p{{L}}"))
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self._place(keys)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.chunks = ChunkCache(self._pieces)
        self.content, self.split_rule, self.library = content, split["pattern"]["Regex"], None

    # words ---------------------------------------------------------------

    def chunk_words(self, chunk: str) -> list[str]:
        """The words of a lower-cased chunk between white space."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk]
        if "<|" not in chunk and self.split_rule == RULE and QUICK.fullmatch(chunk):
            return QUICK_WORDS.findall(chunk)
        return self.words(chunk)

    def words(self, text: str) -> list[str]:
        """Words as the file's normalizer and pre-tokenizer cut them; special
        tokens in the text stay whole."""
        if "<|" not in text or not self.special_pattern.search(text):
            return self._plain_words(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self._plain_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain_words(text[at:])

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii() and UNSURE.search(text):
            if self.library is None:
                from tokenizers import Regex, Tokenizer, pre_tokenizers

                self.library = Tokenizer.from_str(self.content).normalizer, pre_tokenizers.Split(Regex(self.split_rule), "removed", invert=True)
            return [w for w, _ in self.library[1].pre_tokenize_str(self.library[0].normalize_str(text))]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.word_pattern.findall(text)

    # merging -------------------------------------------------------------

    def _place(self, keys: np.ndarray) -> None:
        """Pairs and their ranks in a table of hashed rows of SLOTS."""
        self.bits, self.factor = 16, np.uint64(0x9E3779B97F4A7C15)
        while True:
            row = (keys.astype(np.uint64) * self.factor >> np.uint64(64 - self.bits)).astype(np.int64)
            order = np.argsort(row, kind="stable")
            sizes = np.bincount(row, minlength=1 << self.bits)
            if sizes.max(initial=0) <= SLOTS:
                break
            self.bits += 1
        slot = np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[row[order]]
        self.pairs, self.ranks = np.full((1 << self.bits, SLOTS), -1, np.int64), np.full((1 << self.bits, SLOTS), NONE)
        self.pairs[row[order], slot], self.ranks[row[order], slot] = keys[order], order

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where the two do not merge."""
        key = np.where((a >= 0) & (b >= 0), (a << 32) | b, -2)
        row = (key.astype(np.uint64) * self.factor >> np.uint64(64 - self.bits)).astype(np.int64)
        same = self.pairs[row] == key[:, None]
        slot = same.argmax(1)
        return np.where(same[np.arange(len(key)), slot], self.ranks[row, slot], NONE)

    def _merge_rows(self, words: list[bytes], size: int) -> tuple[np.ndarray, list[int]]:
        """Words of 2 to size bytes, in rows of one array of segment trees: the
        ids of all of them and where those of each word end."""
        n, lengths = len(words), np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        starts = np.cumsum(lengths) - lengths
        col = np.arange(len(flat)) - np.repeat(starts, lengths)
        width = size + 1
        sym = np.full(n * width, -1, np.int64)
        sym[row * width + col] = self.first[flat]
        ends = starts + lengths - 1
        sym[np.arange(n) * width + lengths - 1] = self.last[flat[ends]]
        after = np.tile(np.arange(1, width + 1), n)
        before = np.tile(np.arange(-1, width - 1), n)
        grid = sym.reshape(n, width)
        leaf = self._rank(grid[:, :size].ravel(), grid[:, 1:].ravel())
        place = np.tile(np.arange(size), n)
        leaf = np.where(leaf == NONE, NONE, leaf * size + place)
        tree = np.full((n, 2 * size), NONE)
        tree[:, size:] = leaf.reshape(n, size)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        tree = tree.ravel()
        rows = np.arange(n)
        while len(rows):
            root = tree[rows * (2 * size) + 1]
            live = root != NONE
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            at, base, trunk = root % size, rows * width, rows * (2 * size)
            gone = after[base + at]
            nxt = after[base + gone]
            sym[base + at] = self.merged[root // size]
            sym[base + gone] = -1
            after[base + at] = nxt
            inner = nxt < size
            before[(base + nxt)[inner]] = at[inner]
            right = np.where(inner, sym[base + np.minimum(nxt, size)], -1)
            prev = before[base + at]
            has = prev >= 0
            left = np.where(has, sym[base + np.maximum(prev, 0)], -1)
            mine = sym[base + at]
            value = self._rank(np.concatenate([mine, left]), np.concatenate([right, mine]))
            place = np.concatenate([at, prev])
            value = np.where(value == NONE, NONE, value * size + place)
            k = len(rows)
            tree[trunk + size + gone] = NONE
            tree[trunk + size + at] = value[:k]
            tree[(trunk + size + prev)[has]] = value[k:][has]
            node = np.concatenate([at, gone, np.where(has, prev, at)]) + size
            stem = np.concatenate([trunk, trunk, trunk])
            while True:
                node >>= 1
                if not node[0]:
                    break
                child = stem + 2 * node
                tree[stem + node] = np.minimum(tree[child], tree[child + 1])
        kept = grid[:, :size] >= 0
        return grid[:, :size][kept], np.cumsum(kept.sum(1)).tolist()

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word of any length, with a tree of its own."""
        n = len(word)
        size = 1 << (n - 1).bit_length()
        sym = self.first[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank_of, far = self.rank_of, int(NONE)

        def leaf(i: int) -> int:
            j = after[i]
            rank = rank_of.get((sym[i] << 32) | sym[j]) if j < n else None
            return far if rank is None else rank * size + i

        tree = [far] * (2 * size)
        tree[size : size + n] = [leaf(i) for i in range(n)]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] != far:
            rank, i = divmod(tree[1], size)
            j = after[i]
            sym[i], sym[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, far)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return np.array([s for s in sym if s >= 0])

    def _encoded(self, words: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, list[int]]]:
        """Groups of distinct words: their ids and where those of each end."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            if w in self.special:
                yield [w], np.array([self.special[w]]), [1]
            elif len(b) == 1:
                yield [w], self.last[[b[0]]], [1]
            elif len(b) <= 64:
                groups.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((w, b))
            else:
                ids = self._merge_long(b)
                yield [w], ids, [len(ids)]
        for size, group in groups.items():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                yield [w for w, _ in part], *self._merge_rows([b for _, b in part], size)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each distinct word."""
        out: dict[str, list[int]] = {}
        for part, ids, ends in self._encoded(words):
            ids, at = ids.tolist(), 0
            for w, end in zip(part, ends, strict=True):
                out[w] = ids[at:end]
                at = end
        return out

    # texts ---------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        ids = self.encode_words(set(words))
        return [i for w in words for i in ids[w]]

    def decode(self, ids: Iterable[int]) -> str:
        """As the file has no decoder: the tokens with a space between."""
        return " ".join(self.tokens[i] for i in ids)

    def _learn(self, words: set[str]) -> None:
        cache, token = self.cache, self.tokens.__getitem__
        for part, ids, ends in self._encoded(words):
            packed, tokens, at = ids.astype("<u4").tobytes(), list(map(token, ids.tolist())), 0
            for w, end in zip(part, ends, strict=True):
                cache[w] = (packed[4 * at : 4 * end], (" ".join(tokens[at:end]) + " ").encode())
                at = end

    def _pieces(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each chunk (little-endian, 32 bits), and its tokens in
        UTF-8, each with a space behind."""
        cut = list(map(self.chunk_words, chunks))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self._learn({w for words in cut for w in words}.difference(self.cache))
        cache, out = self.cache, []
        for words in cut:
            pairs = [cache[w] for w in words]
            out.append(pairs[0] if len(pairs) == 1 else (b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
        return out

    def forget(self) -> None:
        """Gives back what a task has gathered; an idle worker holds no words."""
        self.cache = {}
        self.chunks.clear()

    def encoded_and_decoded(self, column: pa.Array) -> Iterator[tuple[int, list[memoryview], list[memoryview]]]:
        """By slices of a column of texts: the first text's place, of each text
        its ids (little-endian, 32 bits) and the decoded text in UTF-8."""
        for first, upto, numbers, values in self.chunks.of(column):
            parts = []
            for k in (0, 1):
                data, places = joined([v[k] for v in values], numbers)
                ends, raw = places[upto].tolist(), memoryview(data)
                parts.append([raw[a : max(a, b - k)] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
            yield first, *parts


_held: dict[str, WordBpe] = {}


def worker_bpe(content: str) -> WordBpe:
    """One encoder a Python worker and file, kept from task to task."""
    key = hashlib.md5(content.encode()).hexdigest()
    if key not in _held:
        _held[key] = WordBpe(content)
    return _held[key]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` the
    ids and the decoded text as well. One row for each row; null text counts as
    empty; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one file of fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(content.value)
        for batch in batches:
            for first, ids, decoded in bpe.encoded_and_decoded(batch.column(1)):
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string()) for part in (ids, decoded)]
                columns = [batch.column(0).slice(first, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), *digests]
                if with_ids:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([bytes(x).decode() for x in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.forget()

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    short_batches(spark)
    return docs.select(id_col, text_col).mapInArrow(released(run), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
