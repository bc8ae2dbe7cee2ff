"""Quality classifier on random-indexing word vectors.

A word is a run of letters, digits and longer UTF-8 bytes, or a run of other
marks. Every word has a sparse random index vector of -1 and 1, drawn from its
hash. A word's context is the sum of the index vectors that stand within two
places of it; contexts are summed over the whole corpus for each trigram of
symbols that the words hold, and a word's vector is the normalised sum of its
trigrams' vectors. So each word has a vector and a frequency of its own, one
that occurs only once or nowhere too, while the table has a row for each
trigram of SYMBOLS symbols, however large the vocabulary: rows are never shared
by hashing, and are the same at every size. Sums are whole numbers, so they do
not depend on the order of the work.

A document is pooled to the mean and spread of its word vectors, the mean of
their frequency weights and the agreement of neighbours' index vectors. A
two-layer network learns from a bounded sample of labelled documents; its
logits are divided by a temperature that fits documents it has not learned
from.

Null and empty texts pool to zeros and get the network's score for that. With
labels of one kind only, or none, every score is the labels' mean, or 0.5. Of
several texts of one labelled id one is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import released, short_batches
from quillon.llm.labelled import crc_mod, labelled_sample, labelled_texts, with_double
from quillon.llm.wordcut import cut, slices, word_hashes

#: Length of the vectors, and the entries of an index vector that are not 0.
DIMS, MARKS = 24, 4
#: Labelled documents that are learned from, at most.
MOST_LABELLED = 12_000
#: Bytes of texts that are worked on at once.
SLICE = 2_000_000
AS_THEY_ARE = np.arange(256, dtype=np.uint8)
#: Bytes of a word; neighbours of different kinds are different words.
KINDS = np.full(256, 1, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[[b for b in range(128) if KINDS[b] and not (chr(b).isalnum() or b == 95)]] = 2


def _symbols() -> tuple[np.ndarray, int]:
    """What each byte counts as in a trigram; 0 stands for a word's edge."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        if b < 128 and chr(b).isalpha():
            out[b] = 1 + ord(chr(b).lower()) - 97
        elif b < 128 and chr(b).isdigit():
            out[b] = 27
        elif b < 128:
            out[b] = 28 + [b == 95, b in (44, 46), b in (39, 45), True].index(True)
        elif b < 192:
            out[b] = 32 + (b >> 4 & 3)
        else:
            out[b] = 36 + [b < 0xC4, b < 0xE0, b < 0xF0, True].index(True)
    return out, int(out.max()) + 1


SYMBOL_OF, SYMBOLS = _symbols()
ROWS = SYMBOLS**3


def _patterns() -> np.ndarray:
    """All index vectors: one entry, -1 or 1, in each of MARKS parts."""
    width = DIMS // MARKS
    out = np.zeros(((2 * width) ** MARKS, DIMS), np.int8)
    number = np.arange(len(out))
    for k in range(MARKS):
        way = number // (2 * width) ** k % (2 * width)
        out[number, width * k + way // 2] = way % 2 * 2 - 1
    return out


PATTERNS = _patterns()


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The index vector of each word, a row each."""
    return np.take(PATTERNS, (hashes % np.uint64(len(PATTERNS))).astype(np.int64), axis=0)


@dataclass
class Words:
    """The words of some texts: where each text's end, their numbers among the
    distinct ones, their index vectors with two rows of zeros behind each text,
    and their places among those; and of the distinct ones the trigrams, where
    those begin and how often the word occurs."""

    ends: np.ndarray
    number: np.ndarray
    index: np.ndarray
    place: np.ndarray
    trigrams: np.ndarray
    begins: np.ndarray
    counts: np.ndarray


def words_of(data: np.ndarray, ends: np.ndarray) -> Words:
    begins, stops, upto = cut(data, ends, KINDS)
    hashes = word_hashes(data, begins, stops, AS_THEY_ARE)
    place = np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))
    index = np.zeros((len(hashes) + 2 * len(upto), DIMS), np.int8)
    index[place] = index_vectors(hashes)
    coded = pa.array(hashes.view(np.int64)).dictionary_encode()
    number = np.asarray(coded.indices)
    counts = np.bincount(number, minlength=len(coded.dictionary))
    first = np.zeros(len(counts), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    sizes = (stops - begins)[first]
    edge = np.cumsum(sizes)
    symbols = SYMBOL_OF[data[np.repeat(begins[first] - (edge - sizes), sizes) + np.arange(int(sizes.sum()))]]
    before, after = np.zeros_like(symbols), np.zeros_like(symbols)
    before[1:], after[:-1] = symbols[:-1], symbols[1:]
    before[edge - sizes], after[edge - 1] = 0, 0
    return Words(upto, number, index, place, (before * SYMBOLS + symbols) * SYMBOLS + after, edge - sizes, counts)


def add_contexts(sums: np.ndarray, words: Words) -> None:
    """Adds the words' contexts to their trigrams' columns; the last row counts
    words. Doubles hold these whole numbers without rounding."""
    if not len(words.number):
        return
    x = words.index
    context = np.zeros_like(x)
    for gap in (1, 2):
        context[gap:] += x[:-gap]
        context[:-gap] += x[gap:]
    context = np.ascontiguousarray(context[words.place].T)
    word = np.repeat(np.arange(len(words.counts)), np.diff(words.begins, append=len(words.trigrams)))
    for k in range(DIMS + 1):
        own = np.bincount(words.number, context[k], len(words.counts)) if k < DIMS else words.counts
        sums[k] += np.bincount(words.trigrams, own[word], ROWS).astype(np.int64)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Column by column, for each trigram: the corpus's context sums and, last,
    the number of words that hold it (each place in a word counts).

    Each task adds up its own share and sends one line a trigram that it met;
    the result has a fixed size (DIMS + 1 by ROWS).
    """
    names = [f"v{k}" for k in range(DIMS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((DIMS + 1, ROWS), np.int64)
        for batch in batches:
            for _, data, ends in slices(batch.column(0), SLICE):
                add_contexts(sums, words_of(data, ends))
        used = np.flatnonzero(sums[DIMS])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in sums)], ["row", *names])

    parts = docs.select(text_col).mapInArrow(released(run), "row long, " + ", ".join(f"{n} long" for n in names))
    got = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # ROWS at most
    out = np.zeros((DIMS + 1, ROWS), np.int64)
    out[:, got["row"].to_numpy()] = got[names].to_numpy().T
    return out


@dataclass
class QualityModel:
    """vectors: unit trigram vectors, a column each; shares: how often each occurs in a word of
    the corpus; the rest: the network."""

    vectors: np.ndarray
    shares: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    prior: float | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        """A score for each text of a column."""
        if self.prior is not None:
            return np.full(len(column), self.prior)
        parts = [_sigmoid(_forward(self.layers, (x - self.mean) / self.scale)[1] / self.temperature) for _, x in pooled(self.vectors, self.shares, column)]
        return np.concatenate([*parts, np.zeros(0)])


def word_vectors(vectors: np.ndarray, shares: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the distinct words, a column each, and their weights: the
    less the more often even the rarest trigram of the word occurs."""
    out = np.empty((DIMS, len(words.begins)), np.float32)
    for k in range(DIMS):
        np.add.reduceat(vectors[k][words.trigrams], words.begins, out=out[k])
    out /= np.maximum(np.sqrt((out * out).sum(0)), 1e-9)
    return out, 1e-3 / (1e-3 + np.minimum.reduceat(shares[words.trigrams], words.begins))


def pooled(vectors: np.ndarray, shares: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """By slices of a column of texts the first text's place and one row a text:
    mean and spread of its word vectors, mean weight, neighbours' agreement,
    logarithm of its length. vectors: a column for each trigram."""
    for first, data, ends in slices(column, SLICE):
        words = words_of(data, ends)
        n = np.diff(words.ends, prepend=0)
        out = np.zeros((len(n), 2 * DIMS + 4))
        if len(words.number):
            some = np.flatnonzero(n)
            starts, one = (words.ends - n)[some], n[some]
            mean_of = lambda x: np.add.reduceat(x, starts, dtype=np.float64) / one
            own, weight = word_vectors(vectors, shares, words)
            for k in range(DIMS):
                seen = own[k][words.number]
                mean = out[some, k] = mean_of(seen)
                out[some, DIMS + k] = np.sqrt(np.maximum(mean_of(seen * seen) - mean * mean, 0))
            out[some, 2 * DIMS] = mean_of(weight[words.number])
            for gap in (1, 2):
                alike = np.einsum("ij,ij->i", words.index[:-gap], words.index[gap:])
                out[some, 2 * DIMS + gap] = mean_of(alike[words.place]) / MARKS
            out[some, 2 * DIMS + 3] = np.log1p(one) / 10
        yield first, out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.tanh(x @ a + b)
    return hidden, (hidden @ c + d)[:, 0]


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 300, decay: float = 1e-3) -> list[np.ndarray]:
    """Two layers, cross-entropy, Adam, mini-batches in a fixed random order."""
    rng = np.random.default_rng(11)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    size = max(64, len(x) // 12)
    for turn in range(rounds):
        rate = 0.01 if turn < rounds * 2 // 3 else 0.002
        order = rng.permutation(len(x))
        for k in range(0, len(x), size):
            own = order[k : k + size]
            h, z = _forward(layers, x[own])
            g = ((_sigmoid(z) - y[own]) / len(own))[:, None]
            back = (g @ layers[2].T) * (1 - h * h)
            grads = [x[own].T @ back + decay * layers[0], back.sum(0), h.T @ g + decay * layers[2], g.sum(0)]
            step += 1
            for i, d in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, by golden-section search."""
    loss = lambda t: float(np.mean(np.logaddexp(0, z / np.exp(t)) - y * z / np.exp(t)))
    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def trigram_vectors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors about the corpus's mean, and shares, from context sums."""
    counts = sums[DIMS].astype(float)
    vectors = sums[:DIMS] / np.maximum(counts, 1)
    total = max(counts.sum(), 1)
    vectors = np.where(counts > 0, vectors - (vectors * counts).sum(1, keepdims=True) / total, 0)
    return (vectors / np.maximum(np.sqrt((vectors**2).sum(0)), 1e-9)).astype(np.float32), counts / total


def fit_quality(docs: DataFrame, labels: DataFrame, learn=None, label_col: str = "quality", most: int = MOST_LABELLED) -> QualityModel:
    """Word vectors from all of docs; the network from at most so many labelled
    documents, of which every fifth only sets the temperature.

    docs: doc_id, text; labels: doc_id, label_col; learn: which label rows may
    be learned from, as a condition.
    """
    short_batches(docs.sparkSession)
    vectors, shares = trigram_vectors(context_sums(docs))
    held = docs.sparkSession.sparkContext.broadcast((vectors, shares))
    width = 2 * DIMS + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in pooled(*held.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(x)), batch.column(2).slice(first, len(x)), pa.FixedSizeListArray.from_arrays(x.ravel(), width).cast(pa.list_(pa.float64()))], ["_id", "_label", "x"])

    pairs = labelled_texts(docs, labelled_sample(labels, label_col, F.lit(True) if learn is None else learn, most))
    kind = pairs.schema["_id"].dataType.simpleString()
    got = pairs.mapInArrow(released(run), f"_id {kind}, _label double, x array<double>").toPandas()  # most rows of width numbers
    got = got.sort_values(["_id"], kind="stable")
    y = got["_label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return QualityModel(vectors, shares, np.zeros(width), np.ones(width), [], 1.0, float(y.mean()) if len(y) else 0.5)
    x = np.stack(got["x"].to_list())
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    fifth = np.arange(len(y)) % 5 == 4
    layers = train_network(x[~fifth], y[~fifth])
    temperature = fit_temperature(_forward(layers, x[fifth])[1], y[fifth]) if fifth.any() else 1.0
    return QualityModel(vectors, shares, mean, scale, layers, temperature)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1) behind its columns, in place of any column
    of that name. One row for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    schema = with_double(docs.schema, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(batch.column(at)), pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(released(run), schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs, labels, learn=crc_mod(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
