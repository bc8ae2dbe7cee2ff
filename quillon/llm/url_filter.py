"""URL filter: rules first, then a character language-model ratio.

Urls that a rule allows train one variable-order Markov model of their bytes,
urls that a rule blocks another. A model mixes contexts of 0 to ORDER bytes:
each order's estimate is smoothed by that of the next shorter one. Urls that no
rule fits are judged by the difference of the two log-likelihoods divided by
the length, turned into a probability that held-back ruled urls calibrate.

The counts cover every ruled url. They are exact and a distributed table, a row
for each context, and each context with a byte: at most ORDER + 1 bytes, which
with their number fit a whole number of 64 bits. Urls are judged in chunks; a
chunk's distinct grams are joined with the table and come back to its urls.
UrlModel is the same mixture over counts in hashed slots, in memory, for tables
that are small; no query uses it.

Null urls and urls without ``://`` have an empty host and path and nothing to
judge: they are blocked. Where rules allow or block nothing at all, there is
no ratio, and other urls are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, written

#: Longest context in bytes, slots for each table of counts (a power of two)
#: and the weight of the shorter context's estimate.
ORDER, SLOT_BITS, WEIGHT = 5, 18, 3.0
SLOTS = 1 << SLOT_BITS
#: Urls that are judged, or counted before the first shuffle, together.
CHUNK = 2000
#: One ruled url in so many calibrates and is not counted.
CALIBRATE = 5
#: Bins of the calibrating histogram, over ratios of -RANGE to RANGE.
BINS, RANGE = 800, 4.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, text: str, verdict: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(host, "/" + path, verdict)


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all that follows the first ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), rest


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    fit = [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r) for r in sorted(rules, key=lambda r: -len(r.text))]
    pick = lambda f: F.coalesce(*(F.when(c, F.lit(f(r))) for c, r in fit), F.lit(None).cast("string"))
    return pick(lambda r: r.text), pick(lambda r: r.verdict)


def _bytes(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, ORDER start marks before each url and an end mark behind;
    the places that are judged; the number of those of each url."""
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b"".join(b"\x02" * ORDER + r + b"\x03" for r in raw), np.uint8).astype(np.uint64)
    keep = np.ones(len(data), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    keep[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return data, np.nonzero(keep)[0], sizes


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like _slots, but exact: the context's bytes, and the context's bytes
    and the byte, as whole numbers, with the order and which of both above."""
    data, here, sizes = _bytes(urls)
    data = data.astype(np.int64)
    context, with_byte = np.empty((ORDER + 1, len(here)), np.int64), np.empty((ORDER + 1, len(here)), np.int64)
    packed = np.zeros(len(here), np.int64)
    for k in range(ORDER + 1):
        if k:
            packed = packed | data[here - k] << 8 * (k - 1)
        context[k] = packed | k << 48
        with_byte[k] = packed << 8 | data[here] | (k + ORDER + 1) << 48
    return context, with_byte, sizes


def _slots(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every url, its end mark included, and every order:
    the slots of the context and of the context with the byte. Last: the
    number of bytes of each url, mark included."""
    data, here, sizes = _bytes(urls)
    last = data[here]
    context, with_byte = np.empty((ORDER + 1, len(here)), np.int64), np.empty((ORDER + 1, len(here)), np.int64)
    h = np.zeros(len(here), np.uint64)
    mix, step, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3), np.uint64(64 - SLOT_BITS)
    for k in range(ORDER + 1):
        if k:
            h = (h ^ (data[here - k] + np.uint64(1))) * step
        salted = h + mix * np.full(1, k + 1, np.uint64)
        context[k] = ((salted ^ (salted >> np.uint64(29))) * mix >> shift).astype(np.int64)
        salted = (h * step ^ (last + np.uint64(7))) * mix + step * np.full(1, k + 1, np.uint64)
        with_byte[k] = ((salted ^ (salted >> np.uint64(31))) * mix >> shift).astype(np.int64)
    return context, with_byte, sizes


def _ratio(seen: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> np.ndarray:
    """The ratio of each url. seen: by class (0 accepted, 1 rejected) how often
    the contexts, and the contexts with the byte, occur, by order and place."""
    logs = []
    for context, with_byte in seen:
        p = np.full(context.shape[1], 1 / 256)
        for k in range(ORDER + 1):
            p = (np.minimum(with_byte[k], context[k]) + WEIGHT * p) / (context[k] + WEIGHT)
        logs.append(np.log(p))
    return np.add.reduceat(logs[0] - logs[1], np.cumsum(sizes) - sizes) / sizes


@dataclass
class UrlModel:
    """counts: by class (0 accepted, 1 rejected), table (0 contexts, 1 contexts
    with a byte) and slot."""

    counts: np.ndarray

    def ratio(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood under the accepted model less that under the
        rejected one, per byte; positive: more like the accepted urls."""
        if not urls:
            return np.zeros(0)
        context, with_byte, sizes = _slots(urls)
        return _ratio([(c[0][context], c[1][with_byte]) for c in self.counts], sizes)


def _platt(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and level of the log-odds, by Newton steps over the histograms of
    both classes, which count alike."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * RANGE - RANGE
    wg, wb = good / good.sum(), bad / bad.sum()
    t = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
    theta = np.array([1.0, 0.0])
    loss = lambda th: float(np.sum((wg + wb) * np.logaddexp(0, th[0] * x + th[1]) - (wg * t[0] + wb * t[1]) * (th[0] * x + th[1])))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -50, 50)))
        d = (wg + wb) * p - wg * t[0] - wb * t[1]
        c = (wg + wb) * p * (1 - p)
        hessian = np.array([[np.sum(c * x * x), np.sum(c * x)], [np.sum(c * x), np.sum(c)]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(hessian, np.array([np.sum(d * x), np.sum(d)])), 1.0
        while size > 1e-4 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
    return float(theta[0]), float(theta[1])


def gram_counts(ruled: DataFrame) -> DataFrame:
    """(gram, n0, n1): how often each gram occurs in accepted and in rejected
    urls. ruled: rest (the url's text behind ``://``), blocked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                context, with_byte, sizes = grams(part.column(0).to_pylist())
                blocked = np.repeat(part.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
                keys, place = np.unique(np.vstack([context, with_byte]).ravel(), return_inverse=True)
                bad = np.bincount(place, np.tile(blocked, 2 * (ORDER + 1)), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(keys), "n0": pa.array(np.bincount(place, minlength=len(keys)) - bad), "n1": pa.array(bad)})

    return ruled.select("rest", "blocked").mapInArrow(count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def ratios(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(at, ratio): log-likelihood under the accepted model less that under the
    rejected one, per byte; positive: more like the accepted urls. urls: at (a
    number of its own for each row), rest; counts: of gram_counts."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, part.column(0)[0].as_py(), np.int64)), *part.columns], ["chunk", "at", "rest"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = np.asarray(batch.column(0))
            for c in np.unique(chunks):
                keys = np.unique(np.vstack(grams(batch.filter(pa.array(chunks == c)).column(1).to_pylist())[:2]))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(keys), c)), "gram": pa.array(keys)})

    def judge(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        context, with_byte, sizes = grams(own.column("rest").to_pylist())
        # a chunk that several batches cut asks for some grams more than once
        keys, first = np.unique(found.column("gram").to_numpy(), return_index=True)
        keys = np.append(keys, np.iinfo(np.int64).max)
        places = [np.searchsorted(keys, x) for x in (context, with_byte)]
        seen = []
        for n in ("n0", "n1"):
            counted = np.append(found.column(n).to_numpy()[first], 0)
            seen.append(tuple(np.where(keys[p] == x, counted[p], 0) for p, x in zip(places, (context, with_byte), strict=True)))
        return pa.table({"at": own.column("at"), "ratio": pa.array(_ratio(seen, sizes))})

    chunks = written(urls.select("at", "rest").mapInArrow(chunk, "chunk long, at long, rest string"), "url-chunks")
    asked = chunks.select("chunk", "rest").mapInArrow(needed, "chunk long, gram long")
    found = written(asked.join(counts, "gram").select("chunk", "gram", "n0", "n1"), "url-grams")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(judge, "at long, ratio double")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Judges every url. Returns the columns in keep, then host, path, rule,
    verdict (allow or block), ratio (null where a rule decides) and p_allow."""
    host, path, rest = host_and_path(F.col(url_col))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    every = written(parts.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("_given"), F.col("rest").alias("_rest"), F.monotonically_increasing_id().alias("_at")), "urls")
    text = every.select(F.col("_at").alias("at"), F.col("_rest").alias("rest"), (F.col("_given") == "block").alias("blocked"), F.col("rule").isNull().alias("open"), (F.crc32(F.col("_rest").cast("binary")) % CALIBRATE == 0).alias("held"))
    counted = text.where("not open and not held")
    usable = counted.select("blocked").distinct().count() == 2  # 2 rows at most
    histogram = np.zeros((2, BINS))
    if usable:
        counts = written(gram_counts(counted), "url-counts")
        judged = written(ratios(text.where("open or held"), counts), "url-ratios")
        bins = F.least(F.greatest(F.floor((F.col("ratio") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
        for r in text.where("not open and held").join(judged, "at").groupBy("blocked", bins.alias("bin")).count().collect():  # 2 * BINS rows at most
            histogram[int(r[0]), r[1]] = r[2]
        usable = bool(histogram.sum(1).min())
    if usable:
        slope, level = _platt(*histogram)
        every = every.join(judged, F.col("_at") == F.col("at"), "left").drop("at")
        p = 1 / (1 + F.exp(-F.greatest(F.least(slope * F.col("ratio") + level, F.lit(50.0)), F.lit(-50.0))))
    else:
        every, p = every.withColumn("ratio", F.lit(None).cast("double")), F.lit(1.0)
    open_ = F.col("rule").isNull()
    every = every.withColumn("ratio", F.when(open_, F.col("ratio"))).withColumn("p_allow", F.when(open_, p))
    given = F.coalesce("_given", F.when((F.col("_rest") != "") & (F.col("p_allow") >= 0.5), "allow").otherwise("block"))
    return every.select(*keep, "host", "path", "rule", given.alias("verdict"), "ratio", "p_allow")


RULES = (
    Rule.of("com/", "allow"),
    Rule.of("example.com/en/", "block"),
    Rule.of("www.example.com/en/", "allow"),
    Rule.of("net/es/", "block"),
    Rule.of("net/fr/", "block"),
)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
