"""Counterfactual-regularised toxicity classifier.

A linear model over the words of a text and the beginnings of those words,
each counted once. It learns from a bounded sample of labelled rows. Beside
the log-loss it pays for every change of score that a swap of identity terms
makes: in each sentence of the labelled rows that names a group, the terms are
swapped for others of their kind, and the same is done in a few neutral
sentences about each group. So the model gets no weight from the mention of a
group alone. Of two swaps only the features that change matter; equal changes
are sent and learned from once, with their number.

Null and empty texts score as the bias does. With labels of one kind only, or
none, every score is the labels' mean, or 0.5. Of several texts of one labelled
id one is learned from. Other columns stay.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import released, short_batches
from quillon.llm.labelled import crc_mod, labelled_sample, labelled_texts, with_double

WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
FEATURES = 1 << 20
#: Labelled rows that are learned from, at most.
MOST_LABELLED = 6_000
#: Features of fewer labelled rows have no weight.
LEAST_ROWS = 4
CACHE_WORDS = 500_000
#: Terms for groups of people; a swap stays within a line.
GROUPS = (
    "women men girls boys",
    "woman man girl boy",
    "christian muslim jewish hindu buddhist atheist",
    "christians muslims jews hindus buddhists atheists",
    "black white asian african european latino arab",
    "gay straight lesbian bisexual transgender",
    "immigrant refugee foreigner native citizen",
    "immigrants refugees foreigners natives citizens",
    "disabled blind deaf autistic",
    "old young elderly",
    "frauen männer mädchen jungen",
    "christen muslime juden",
    "femmes hommes filles garçons",
    "chrétiens musulmans juifs",
    "mujeres hombres niñas niños",
    "cristianos musulmanes judíos",
)
#: Neutral sentences that name a group.
NEUTRAL = ("the {} went home", "i met some {} people today", "she is {} and lives in town", "many {} work here")


def features(word: str) -> tuple[int, ...]:
    """The word itself and its first four to seven letters, hashed."""
    parts = [f"={word}", *(f"{word[:k]}-" for k in range(4, min(7, len(word)) + 1))]
    return tuple(zlib.crc32(p.encode()) % FEATURES for p in parts)


def swaps() -> dict[str, str]:
    """Each identity term and the one that takes its place."""
    out: dict[str, str] = {}
    for line in GROUPS:
        terms = line.split()
        for a, b in zip(terms, [*terms[1:], terms[0]], strict=True):
            out.setdefault(a, b)
    return out


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in words for f in features(w)), np.int32))


def change(words: set[str], other: dict[str, str]) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The features that go and those that come when the identity terms among a
    sentence's words are swapped; None where there are none."""
    named = words & other.keys()
    if not named:
        return None
    own, swapped = features_of(words), features_of((words - named) | {other[w] for w in named})
    return tuple(np.setdiff1d(own, swapped, True).tolist()), tuple(np.setdiff1d(swapped, own, True).tolist())


@dataclass
class ToxicityModel:
    """weights: of the features that have one."""

    weights: dict[int, float]
    bias: float
    prior: float | None = None

    def __post_init__(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def logit(self, text: str) -> float:
        cache, weights, found = self.cache, self.weights, set()
        for w in words_of(text):
            own = cache.get(w)
            if own is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                own = cache[w] = tuple(f for f in features(w) if f in weights)
            if own:
                found.update(own)
        return self.bias + sum(weights[f] for f in sorted(found))

    def score(self, texts: Iterable[str]) -> list[float]:
        z = [0.0 if self.prior is not None else self.logit(t) for t in texts]
        return [self.prior] * len(z) if self.prior is not None else [1 / (1 + float(np.exp(-np.clip(x, -50, 50)))) for x in z]


class Problem:
    """What is learned from: rows of features with labels, and changes that
    swaps make (the features that go and come, and how often)."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, swaps: dict[tuple, int], strength: float = 2.0):
        count = np.zeros(FEATURES, np.int64)
        for r in rows:
            count[r] += 1
        self.used = np.nonzero(count >= LEAST_ROWS)[0]
        place = np.full(FEATURES, -1, np.int32)
        place[self.used] = np.arange(len(self.used))

        def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            cols = [place[s][place[s] >= 0] for s in sets]
            return np.concatenate([*cols, np.zeros(0, np.int32)]), np.repeat(np.arange(len(sets), dtype=np.int32), [len(c) for c in cols])

        self.col, self.row = flat(rows)
        self.gone, self.gone_of = flat([np.asarray(a, np.int32) for a, _ in swaps])
        self.come, self.come_of = flat([np.asarray(b, np.int32) for _, b in swaps])
        times = np.array(list(swaps.values()), float)
        self.pull = strength * times / max(times.sum(), 1)
        positive = max(y.sum(), 1)
        self.y, self.share = y, np.where(y == 1, 0.5 / positive, 0.5 / max(len(y) - positive, 1))

    def _changes(self, w: np.ndarray) -> np.ndarray:
        n = len(self.pull)
        return np.bincount(self.gone_of, w[self.gone], n) - np.bincount(self.come_of, w[self.come], n)

    def loss(self, w: np.ndarray, bias: float) -> float:
        """The log-loss, balanced by class, and the pull-weighted mean squared
        change over the swaps."""
        z = np.bincount(self.row, w[self.col], len(self.y)) + bias
        return float(np.sum(self.share * (np.logaddexp(0, z) - self.y * z)) + np.sum(self.pull * self._changes(w) ** 2))

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = np.bincount(self.row, w[self.col], len(self.y)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - self.y) * self.share
        grad = np.bincount(self.col, g[self.row], len(w))
        if len(self.pull):
            gap = 2 * self.pull * self._changes(w)
            grad += np.bincount(self.gone, gap[self.gone_of], len(w)) - np.bincount(self.come, gap[self.come_of], len(w))
        return grad, float(g.sum())


def train(rows: list[np.ndarray], y: np.ndarray, pairs: dict[tuple, int], strength: float = 2.0, sparse: float = 2e-4, rounds: int = 400) -> tuple[dict[int, float], float]:
    """Weights and bias by proximal Adam: the problem's loss and an L1 term."""
    problem = Problem(rows, y, pairs, strength)
    w, bias = np.zeros(len(problem.used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        grad, slope = problem.gradient(w, bias)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * slope, 0.999 * vb + 0.001 * slope**2
        rate = 0.05
        root = np.sqrt(v / (1 - 0.999**step)) + 1e-6
        w = w - rate * (m / (1 - 0.9**step)) / root
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse / root, 0)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
    kept = np.nonzero(w)[0]
    return dict(zip(problem.used[kept].tolist(), w[kept].tolist(), strict=True)), float(bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn=None, label_col: str = "toxic", most: int = MOST_LABELLED) -> ToxicityModel:
    """Learns from at most so many labelled rows that fulfil learn.

    The workers send hashed features, never texts, and the changes that swaps
    make in a row's sentences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = swaps()
        for batch in batches:
            own, changes = [], []
            for t in batch.column(1).to_pylist():
                own.append(features_of(words_of(t or "")))
                seen = Counter(c for part in SENTENCE_END.split(t or "") if (c := change(words_of(part), other)))
                changes.append([{"gone": a, "come": b, "times": n} for (a, b), n in seen.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(changes, kinds)], ["_id", "_label", "own", "changes"])

    kinds = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32())), ("times", pa.int64())]))

    short_batches(docs.sparkSession)
    pairs = labelled_texts(docs, labelled_sample(labels, label_col, F.lit(True) if learn is None else learn, most))
    kind = pairs.schema["_id"].dataType.simpleString()
    got = pairs.mapInArrow(released(run), f"_id {kind}, _label double, own array<int>, changes array<struct<gone:array<int>,come:array<int>,times:bigint>>").toPandas().sort_values("_id", kind="stable")
    y = got["_label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, 0.0, float(y.mean()) if len(y) else 0.5)
    rows = [np.asarray(r, np.int32) for r in got["own"]]
    changed: Counter[tuple] = Counter()
    for each in got["changes"]:
        for c in each:
            changed[tuple(c["gone"]), tuple(c["come"])] += int(c["times"])
    other = swaps()
    for sentence in NEUTRAL:
        changed.update(change(words_of(sentence.format(a)), other) for a in other)
    del got
    weights, bias = train(rows, y, changed)
    return ToxicityModel(weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1) behind its columns, in place of any column
    of that name. One row for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.score(t.as_py() or "" for t in batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(released(run), with_double(docs.schema, score_col))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels, learn=crc_mod(F.col("doc_id"), 5) != 0)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
