"""Models and term spans, computed again in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import pii, quality, toxicity, url_filter
from quillon.llm.wordcut import word_hashes
from tests.conftest import SF

KIND = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\t-\r ]+")


def some_texts():
    r = random.Random(5)
    return [None, "", " \n", "one", *(" ".join(r.choice(["the", "Café", "x1", "don't", "(well)", "日本", "...", "Zebra", "a_b"]) for _ in range(r.randrange(1, 30))) for _ in range(40))]


def words(text):
    return KIND.findall((text or "").encode())


def index(word):
    data = np.frombuffer(word, np.uint8)
    return quality.index_vectors(word_hashes(data, np.array([0]), np.array([len(data)]), quality.AS_THEY_ARE))[0].astype(int)


def trigrams(word):
    s = [0, *(int(quality.SYMBOL_OF[b]) for b in word), 0]
    return [(a * quality.SYMBOLS + b) * quality.SYMBOLS + c for a, b, c in zip(s, s[1:], s[2:])]


def test_context_sums_as_by_hand(spark):
    sums = np.zeros((quality.DIMS + 1, quality.ROWS), np.int64)
    for t in some_texts():
        own = words(t)
        for i, w in enumerate(own):
            context = sum((index(own[j]) for j in range(max(0, i - 2), min(len(own), i + 3)) if j != i), np.zeros(quality.DIMS, int))
            for g in trigrams(w):
                sums[:, g] += [*context, 1]
    got = quality.context_sums(spark.createDataFrame([(t,) for t in some_texts()], "text string").repartition(3))
    assert (got == sums).all() and got[-1].sum() > 100


def test_pooling_as_by_hand(monkeypatch):
    rng = np.random.default_rng(1)
    vectors, shares = rng.normal(size=(quality.DIMS, quality.ROWS)).astype(np.float32), rng.random(quality.ROWS) * 0.01
    for most in (quality.SLICE, 40):
        monkeypatch.setattr(quality, "SLICE", most)
        got = np.vstack([x for _, x in quality.pooled(vectors, shares, pa.array(some_texts()))])
        for row, t in zip(got, some_texts(), strict=True):
            own = words(t)
            if not own:
                assert not row.any()
                continue
            v = np.array([sum(vectors[:, g].astype(float) for g in trigrams(w)) for w in own])
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            weight = [1e-3 / (1e-3 + min(shares[g] for g in trigrams(w))) for w in own]
            near = [sum(int(index(a) @ index(b)) for a, b in zip(own, own[k:])) / quality.MARKS / len(own) for k in (1, 2)]
            expected = [*v.mean(0), *v.std(0), np.mean(weight), *near, math.log1p(len(own)) / 10]
            assert row == pytest.approx(expected, abs=1e-3)


def test_network_learns_and_temperature_is_best():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    layers = quality.train_network(x, y)
    z = quality._forward(layers, x)[1]
    assert ((z > 0) == (y == 1)).mean() > 0.95
    noisy = np.where(rng.random(600) < 0.2, 1 - y, y)
    t = quality.fit_temperature(z, noisy)
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - noisy * z / t)
    assert t > 1 and all(loss(t) <= loss(t * k) + 1e-9 for k in (0.5, 0.9, 1.1, 2))


def test_toxicity_gradient_as_by_differences():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    y = (rng.random(60) < 0.4).astype(float)
    problem = toxicity.Problem(rows, y, {((1, 2), (3,)): 2, ((), (4, 5)): 1})
    w, bias, step = rng.normal(size=len(problem.used)), 0.3, 1e-6
    grad, slope = problem.gradient(w, bias)
    for k in range(len(w)):
        at = np.eye(len(w))[k] * step
        assert grad[k] == pytest.approx((problem.loss(w + at, bias) - problem.loss(w - at, bias)) / (2 * step), abs=1e-5)
    assert slope == pytest.approx((problem.loss(w, bias + step) - problem.loss(w, bias - step)) / (2 * step), abs=1e-5)
    by_hand = 0.0
    for r, label in zip(rows, y, strict=True):
        z = bias + sum(w[list(problem.used).index(f)] for f in r)
        by_hand += (math.log1p(math.exp(z)) - label * z) * 0.5 / (sum(y) if label else len(y) - sum(y))
    own = dict(zip(problem.used.tolist(), w, strict=True))
    by_hand += 2.0 / 3 * (2 * (own[1] + own[2] - own[3]) ** 2 + (own[4] + own[5]) ** 2)
    assert problem.loss(w, bias) == pytest.approx(by_hand)


def test_swaps_are_made_by_sentence():
    other = toxicity.swaps()
    assert toxicity.change({"plain", "words"}, other) is None
    gone, come = toxicity.change({"muslim", "came"}, other)
    assert set(gone) | set(come) == set(toxicity.features("muslim")) ^ set(toxicity.features(other["muslim"]))


def test_calibration_is_best():
    rng = np.random.default_rng(4)
    edges = np.linspace(-url_filter.RANGE, url_filter.RANGE, url_filter.BINS + 1)
    good, bad = (np.histogram(rng.normal(m, 1, n), edges)[0].astype(float) for m, n in ((0.8, 3000), (-0.5, 700)))
    x, wg, wb = (edges[:-1] + edges[1:]) / 2, good / good.sum(), bad / bad.sum()
    slope, level = url_filter._platt(good, bad)
    t = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
    loss = lambda a, b: np.sum((wg + wb) * np.logaddexp(0, a * x + b) - (wg * t[0] + wb * t[1]) * (a * x + b))
    assert slope > 0 and all(loss(slope, level) <= loss(slope + d, level + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


BASE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def test_terms_as_by_hand(spark):
    r = random.Random(6)
    people = [(f"{n}.{i}@corp{i % 3}.example", n) for i, n in enumerate(["smith", "jones", "miller", "garcia", "rossi"])]
    docs = []
    for d in range(120):
        text = [r.choice(["report", "meeting", "notes", "about", "budget", "house", "garden"]) for _ in range(12)]
        if d % 4 == 0:
            mail, name = people[d // 4 % 5]
            text[3], text[7] = mail, r.choice([name, name.title(), "nobody"])
            if d % 8 == 0:
                text += [people[(d // 4 + 1) % 5][0], f"hapax{'abcdefghij'[d // 8 % 10]}{'klmnopqrst'[d // 80]}"]
        docs.append((d, " ".join(text)))
    docs += [(200, None), (201, ""), (3, docs[3][1])]
    entities, terms = [], []
    for _, t in docs:
        base = [(m.start(), m.end(), "0:" + m[0].lower()) for m in BASE.finditer(t or "")]
        free = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", t or "") if len(m[0]) >= pii.SHORTEST and not any(a < m.end() and b > m.start() for a, b, _ in base)]
        entities.append({e for *_, e in base})
        terms.append(free)
    n_e, n_t = Counter(e for es in entities for e in es), Counter(t for ts in terms for t in {x[2] for x in ts})
    n_te = Counter((t, e) for es, ts in zip(entities, terms, strict=True) for t in {x[2] for x in ts} for e in es)

    def disclosure(t, e):
        p_e = min((n_e[e] + 0.5) / (len(docs) + 1), 0.5)
        p_et = (n_te[t, e] + pii.PRIOR * p_e) / (n_t[t] + pii.PRIOR)
        return math.log2(p_et / p_e) / -math.log2(p_e)

    expected = Counter()
    for (d, _), es, ts in zip(docs, entities, terms, strict=True):
        spans = []
        for a, b, t in ts:
            most = max([disclosure(t, e) for e in es], default=0)
            if most >= pii.GENERALISE:
                spans.append((a, b, "remove" if most >= pii.REMOVE else "generalise"))
        expected[d, tuple(sorted(spans))] += 1
    rows = pii.pii_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = Counter((x["doc_id"], tuple((s["start"], s["end"], s["action"]) for s in x["spans"] if s["kind"] == 4)) for x in rows)
    assert got == expected and sum(len(s) for _, s in expected) > 20


def test_held_out_toxicity_by_bound(spark):
    """What a smaller bound on the sample costs."""
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, most=100)
    assert toxicity.score_toxicity(docs, model).where("score between 0 and 1").count() == docs.count()
