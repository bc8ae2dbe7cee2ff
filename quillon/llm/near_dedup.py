"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same set of shingles are one class, known by the number of
its first row and told from others by its size and 128 bits of hashes. Classes
that agree on a whole band of minima share a bucket, which its smallest class
names: that class is the centre of a group of all classes in its buckets.

In a group the centre is compared with every member, and members that are not
linked with it with all others of other components. A comparison takes the
signatures batch by batch: with a uniform prior, the posterior probability that
the similarity reaches the threshold is known after each batch, and pairs for
which it falls below MISS are dropped. What is left is verified on the full
sets of shingles. Each task returns links that join components, no pairs.

A group of more than GROUP members goes to several tasks: first each compares
its share with the centre; then, if components are left apart, the members
outside the group's largest component are compared with all others, block by
block. So every two classes that share a bucket are compared or are in one
component already, and no link is lost to a cap. Bands are so many that two
documents at the threshold share no bucket with a probability below 1e-5.

Documents without words have an empty set and are linked with nothing. Rows
without an id are linked with nothing and are their own. Rows of one id and one
text are one document; texts that share an id are documents of their own. An
empty table gives an empty result. Other columns, whatever their names, are
kept by drop_near_duplicates and ignored by near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Table, few, fresh, released, short_batches
from quillon.llm.components import connected_components
from quillon.llm.wordcut import BETWEEN_SPACE, cut, mixed, slices, word_hashes

#: Minima a batch of the verification.
BATCH = 25
#: A pair is dropped when it reaches the threshold with less than this
#: probability; bands miss a pair at the threshold with less than MISS_BANDS.
MISS, MISS_BANDS = 1e-6, 1e-5
#: Classes of a group that one task compares with each other.
GROUP = 512
#: The largest signature.
MOST_MINIMA = 160


class Bands(NamedTuple):
    """How many bands of how many minima."""

    number: int
    size: int

    @property
    def minima(self) -> int:
        return self.number * self.size


def bands_for(percent: int) -> Bands:
    """The longest bands that still find what reaches the threshold."""
    if not 40 <= percent <= 100:
        raise ValueError("percent is from 40 to 100")
    t = min(percent / 100, 0.99)
    ways = [Bands(ceil(log(MISS_BANDS) / log(1 - t**k)) + 1, k) for k in range(1, 41)]
    return max((b for b in ways if b.minima <= MOST_MINIMA), key=lambda b: b.size)


def least_matches(threshold: float, minima: int, miss: float = MISS) -> list[tuple[int, int]]:
    """After how many minima how many must match: with a uniform prior, m of n
    matches leave the similarity at the threshold or above with the
    probability of m or less successes in n + 1 draws."""
    out = []
    for n in [*range(BATCH, minima, BATCH), minima]:
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


# sets and signatures -----------------------------------------------------


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By slices of a column of texts: the first text's place; the distinct
    shingles' hashes, sorted, text after text; where those of each text end.
    A text of fewer words than size, but not none, is one shingle."""
    for first, data, ends in slices(column):
        begins, stops, upto = cut(data, ends, BETWEEN_SPACE)
        words = word_hashes(data, begins, stops)
        counts = np.diff(upto, prepend=0)
        per = np.where(counts >= size, counts - size + 1, counts > 0)
        last = np.cumsum(per)
        flat = np.zeros(int(last[-1]), np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        whole = np.ones(len(flat), bool)
        whole[last[short] - 1] = False
        n = len(words) - size + 1
        if n > 0:
            x = np.zeros(n, np.uint64)
            for k in range(size):
                x = mixed(x ^ words[k : k + n], k) + np.uint64(k)
            flat[whole] = x[np.arange(n) + size <= np.repeat(upto, counts)[:n]]
        x = counts[short].astype(np.uint64) << np.uint64(40)
        for k in range(size - 1):
            more = counts[short] > k
            x[more] = mixed(x[more] ^ words[(upto - counts)[short][more] + k], k + 1) + np.uint64(size + k)
        flat[last[short] - 1] = x
        for a, b in zip((last - per).tolist(), last.tolist(), strict=True):
            if b - a > 1:
                flat[a:b].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[(last - per)[per > 0]] = True
        upto = np.concatenate([[0], np.cumsum(new)])
        yield first, flat[new], upto[last]


_minhash_rng = np.random.default_rng(5)
_FACTORS = (_minhash_rng.integers(1, 1 << 31, MOST_MINIMA) * 2 + 1).astype(np.uint32)
_OFFSETS = _minhash_rng.integers(0, 1 << 32, MOST_MINIMA).astype(np.uint32)


def signatures(flat: np.ndarray, starts: np.ndarray, minima: int) -> np.ndarray:
    """A row of minima for each set. starts: where the sets, none of them empty,
    begin in flat."""
    half = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((minima, len(starts)), np.uint32)
    for k in range(minima):
        np.minimum.reduceat(half * _FACTORS[k] + _OFFSETS[k], starts, out=out[k])
    return np.ascontiguousarray(out.T)


def band_hashes(sign: np.ndarray, bands: Bands) -> np.ndarray:
    """A row of bucket numbers for each signature; those of one band end in the
    band's number."""
    parts = sign.reshape(len(sign), bands.number, bands.size).astype(np.uint64)
    number = np.arange(bands.number, dtype=np.uint64)
    x = np.broadcast_to(number + np.uint64(1), parts.shape[:2]).copy()
    for k in range(bands.size):
        x = mixed(x ^ parts[:, :, k], k)
    return (x & ~np.uint64(255) | number).view(np.int64)


def _sign(docs: DataFrame, id_col: str, text_col: str, size: int, bands: Bands) -> DataFrame:
    """id, key (of the text), n (size of its set), d1 and d2 (its digest) and
    bands (the buckets), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, ends in shingle_sets(batch.column(2), size):
                n = np.diff(ends, prepend=0)
                starts = (ends - n)[n > 0]
                d1, d2, own = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((0, bands.number), np.int64)
                if len(starts):
                    d1[n > 0] = np.add.reduceat(mixed(flat, 1), starts)
                    d2[n > 0] = np.add.reduceat(mixed(flat * np.uint64(0x9E3779B97F4A7C15), 2), starts)
                    own = band_hashes(signatures(flat, starts, bands.minima), bands)
                places = np.concatenate([[0], np.cumsum((n > 0) * bands.number)]).astype(np.int32)
                kept = [batch.column(k).slice(first, len(n)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(places), pa.array(own.ravel()))], ["id", "key", "n", "d1", "d2", "bands"])

    source = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col)).toDF("id", "key", "text")
    return source.mapInArrow(released(run), "id long, key long, n long, d1 long, d2 long, bands array<long>")


def _sets(needed: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, bands: Bands) -> DataFrame:
    """(rep, sign, s): signatures and sets of the classes in needed (rep, id,
    key), from the texts of their first rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).join(needed, ["id", "key"]).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, ends in shingle_sets(batch.column(1), size):
                starts = np.concatenate([[0], ends[:-1]])
                sign = signatures(flat, starts, bands.minima)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends)), pa.array([r.tobytes() for r in sign], pa.binary()), pa.array([flat[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], ["rep", "sign", "s"])

    return texts.mapInArrow(released(run), "rep long, sign binary, s binary").dropDuplicates(["rep"])


# comparisons -------------------------------------------------------------


def _together(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows that agree in the first so many columns and stand together."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.vstack([np.asarray(batch.column(k)) for k in range(keys)])
        places = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(places[:-1], places[1:], strict=True):
            now = own[:, a].tolist()
            if held and now != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_batches(held)


class Compared:
    """Signatures and sets of a task's members, and what is like what."""

    def __init__(self, sign: pa.Array, sets: pa.Array, percent: int, steps: list[tuple[int, int]]):
        self.sign = np.frombuffer(b"".join(sign.to_pylist()), np.uint32).reshape(len(sign), -1)
        self.sets = [np.frombuffer(s, np.uint64) for s in sets.to_pylist()]
        self.n = np.array([len(s) for s in self.sets])
        self.percent, self.steps = percent, steps

    def alike(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that reach the threshold with one."""
        n = self.n[others]
        others = others[100 * np.minimum(n, self.n[one]) >= self.percent * np.maximum(n, self.n[one])]
        seen, at = np.zeros(len(others), np.int64), 0
        for upto, least in self.steps:
            if not len(others):
                return others
            seen += (self.sign[others, at:upto] == self.sign[one, at:upto]).sum(1)
            others, seen, at = others[seen >= least], seen[seen >= least], upto
        if not len(others):
            return others
        own, n = self.sets[one], self.n[others]
        tokens = np.concatenate([self.sets[j] for j in others.tolist()])
        found = own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens
        common = np.add.reduceat(found, np.cumsum(n) - n, dtype=np.int64)
        return others[100 * common >= self.percent * (len(own) + n - common)]


def group_links(reps: np.ndarray, compared: Compared, whole: bool) -> list[tuple[int, int]]:
    """Links that join the components of a group whose first member is its
    centre; not whole: only those with the centre."""
    root, out = np.arange(len(reps)), []
    linked = compared.alike(0, root[1:])
    root[linked] = 0
    out += [(int(reps[0]), int(reps[j])) for j in linked]
    apart = root != 0
    if whole:
        for i in np.flatnonzero(apart).tolist():
            others = np.flatnonzero((root != root[i]) & (~apart | (np.arange(len(reps)) < i)))
            for j in compared.alike(i, others[others > 0]).tolist():
                if root[j] != root[i]:
                    out.append((int(reps[i]), int(reps[j])))
                    root[root == root[j]] = root[i]
    return out


def _first_links(members: DataFrame, sets: DataFrame, big: DataFrame, percent: int, bands: Bands) -> DataFrame:
    """Links (u, v) of all groups; of big groups (a, parts) only those with the
    centre, which every part has."""
    steps = least_matches(percent / 100, bands.minima)
    tiles = members.join(big, "a", "left")
    own = F.when(F.col("rep") == F.col("a"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    tiles = tiles.select("a", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(own)).alias("part"), "rep", F.col("parts").isNull().alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches, 2):
            if rows.num_rows > 1:
                links = group_links(np.asarray(rows.column(2)), Compared(rows.column(4), rows.column(5), percent, steps), rows.column(3)[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    rows = tiles.join(sets, "rep").select("a", "part", "rep", "whole", "sign", "s")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "rep").mapInArrow(released(run), "u long, v long")


def block_links(reps: np.ndarray, component: np.ndarray, side: np.ndarray, apart: np.ndarray, compared: Compared) -> list[tuple[int, int]]:
    """Links between components of a block: rows of side 0 against those of side
    1; of two that are apart from the largest component only the pair whose
    first has the larger number."""
    component, out = component.copy(), []
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0).tolist():
        others = right[(component[right] != component[i]) & (~apart[right] | (reps[right] < reps[i]))]
        for j in compared.alike(i, others).tolist():
            if component[j] != component[i]:
                out.append((int(reps[i]), int(reps[j])))
                component[component == component[j]] = component[i]
    return out


def _block_links(members: DataFrame, sets: DataFrame, percent: int, bands: Bands) -> DataFrame:
    """Links (u, v) within big groups. members: a, rep, component, apart, and
    the number of blocks of all members (parts) and of those apart (blocks)."""
    steps = least_matches(percent / 100, bands.minima)
    block = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.where("apart").select("a", block("blocks").alias("x"), every("parts").alias("y"), F.lit(0).alias("side"), "rep", "component", "apart")
    right = members.select("a", every("blocks").alias("x"), block("parts").alias("y"), F.lit(1).alias("side"), "rep", "component", "apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches, 3):
            side, reps, component, apart = (rows.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6))
            links = block_links(reps, component, side, apart, Compared(rows.column(7), rows.column(8), percent, steps))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    rows = left.unionByName(right).join(sets, "rep").select("a", "x", "y", "side", "rep", "component", "apart", "sign", "s")
    return rows.repartition("a", "x", "y").sortWithinPartitions("a", "x", "y").mapInArrow(released(run), "u long, v long")


# the operator ------------------------------------------------------------


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Row by row: id, key, n, component (of classes; null without a set or an
    id), component_id and alone (whether no other row is in its component)."""
    bands = bands_for(percent)
    short_batches(docs.sparkSession)
    signed = Table(_sign(docs, id_col, text_col, size, bands).withColumn("row", F.monotonically_increasing_id()), "minhash")
    known = signed.df.where("n > 0 and id is not null")
    classes = known.groupBy("n", "d1", "d2").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count("*").alias("copies"))
    own = known.select("row", "bands").join(classes.select(F.col("rep").alias("row")), "row")
    each = own.select(F.col("row").alias("rep"), F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("bucket", "a")
    members = Table(each.join(shared, "bucket").select("a", "rep").distinct(), "group-members")
    most = members.df.count()
    sizes = members.df.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > GROUP)
    big = Table(sizes.select("a", F.ceil(F.col("m") / GROUP).cast("int").alias("parts")), "big-groups", most // GROUP)

    def sets_of(reps: DataFrame) -> DataFrame:
        needed = Table(reps.distinct().join(known.select(F.col("row").alias("rep"), "id", "key"), "rep"), "compared")
        return _sets(few(needed.df), docs, id_col, text_col, size, bands)

    links = Table(_first_links(members.df, sets_of(members.df.select("rep")), big.df, percent, bands), "links")
    stars = connected_components(links.df, most)
    if not big.df.isEmpty():
        inside = members.df.join(big.df, "a").join(stars.df.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        inside = Table(inside, "big-members", most).df
        parts = inside.groupBy("a", "component").agg(F.count("*").alias("k")).groupBy("a").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.sum("k").alias("all"), F.max("k").alias("k"))
        parts = parts.where("`all` > k").select("a", "top", F.ceil((F.col("all") - F.col("k")) / GROUP).cast("int").alias("blocks"))
        left = Table(inside.join(parts, "a").withColumn("apart", F.col("component") != F.col("top")), "blocks", most)
        if not left.df.isEmpty():
            more = Table(_block_links(left.df, sets_of(left.df.select("rep")), percent, bands), "links")
            joined = connected_components(stars.df.unionByName(more.df), 2 * most)
            stars.drop()
            stars = joined
    label = stars.df.toDF("rep", "component")
    label = label.unionByName(label.select(F.col("component").alias("rep"), "component").distinct())
    label = label.join(classes.select("rep", "least"), "rep")
    label = Table(label.join(label.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("rep", "component", "component_id"), "components")
    named = classes.join(label.df, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "least").alias("component_id"), (F.col("component").isNull() & (F.col("copies") == 1)).alias("alone"))
    # written, so that a class with many copies is joined in parts
    out = signed.df.select("id", "key", "n", "d1", "d2").join(Table(named, "classes").df, ["n", "d1", "d2"], "left")
    has_id = F.col("id").isNotNull()
    return out.select("id", "key", "n", F.when(has_id, F.col("component")).alias("component"), F.when(has_id, F.coalesce("component_id", "id")).alias("component_id"), F.coalesce(F.col("alone") & has_id, F.lit(True)).alias("alone"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles, component_id (the
    smallest id reachable through links), kept (whether that is its own, and of
    several texts of that id the one of the smallest key), and text_key (the
    xxhash64 of its text).

    Two documents are linked when 100 * intersection >= percent * union of
    their sets of shingles of size words.
    """
    rows = _components(docs, id_col, text_col, size, percent)
    first = rows.where("not alone and id = component_id").groupBy("component").agg(F.min("key").alias("first"))
    kept = F.col("alone") | F.col("component").isNull() | ((F.col("id") == F.col("component_id")) & (F.col("key") == F.col("first")))
    out = rows.join(first, "component", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), F.col("key").alias("text_key"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the
    smallest id. All columns stay."""
    rows = _components(docs, id_col, text_col, size, percent).where("not alone and component is not null")
    first = rows.where("id = component_id").groupBy("component").agg(F.min("key").alias("first"))
    gone = rows.join(first, "component").where("id <> component_id or key <> first")
    own_id, own_key = fresh(docs.columns, "near_id", "near_key")
    gone = Table(gone.select(F.col("id").alias(own_id), F.col("key").alias(own_key)).distinct(), "near-duplicates")
    return docs.join(few(gone.df), (F.col(id_col).cast("long") == F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key)), "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _components(docs, "doc_id", "text", 4, 80)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def brute_force(docs: list[tuple[int, str | None]], size: int = 4, percent: int = 80) -> dict[int, tuple[int, int]]:
    """Of each id its set's size and its component, by comparing all pairs."""
    sets = {}
    for d, t in docs:
        w = words_of(t or "")
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for d in sorted(sets):
        meets: dict[int, int] = {}
        for s in sets[d]:
            for e in holders.setdefault(s, []):
                meets[e] = meets.get(e, 0) + 1
            holders[s].append(d)
        for e, common in meets.items():
            if 100 * common >= percent * (len(sets[d]) + len(sets[e]) - common):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}
