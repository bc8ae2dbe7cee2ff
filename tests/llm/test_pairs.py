import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import block_join, decontaminate, line_dedup, near_dedup
from quillon.llm.components import connected_components
from tests.conftest import SF


def test_nearest_as_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [float("inf")] * 8), (2005, []), (2010, [1.0, 2.0]), (2020, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in block_join.block_nearest(frame, F.col("vec_id") % 10 == 0, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: v for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    assert set(got) == {i for i in good if i % 10 == 0}
    for q, found in got.items():
        scores = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                s = 0.0
                for a, b in zip(good[q], v, strict=True):
                    s += a * b
                scores.append((-s, i))
        assert sorted(found) == [(k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:7], 1)]


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_join.block_nearest(empty, F.col("vec_id") % 10 == 0, 5).count() == 0


def test_contamination(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "x y"), (3, None), (4, ""), (5, "same text here"), (5, "same text here"), (None, "z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A b, c d e f g h! i j"), (2, "b c d e f g h"), (3, "x y x y x z"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (10, 9, ["1"]), 2: (7, 0, []), 3: (6, 4, ["2"]), 4: (0, 0, []), 5: (0, 0, [])}
    odd = decontaminate.contamination(odd_docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_items"]) for r in odd) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1), (6, 0)]
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(odd_docs, bench, least_items=1)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (4, 5)").count() == 0 and kept.count() == 5


def test_contamination_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 3)
    monkeypatch.setattr(decontaminate, "few", lambda frame: frame)
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").limit(2)
    bench.createOrReplaceTempView("b2")
    got = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ids = [r["item_id"] for r in bench.collect()]
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet' WHERE item_id IN ({ids[0]}, {ids[1]})")
    assert got == {(d, h, n) for d, _, h, n, _, _ in c.sql(decontaminate.ORACLE3).fetchall()}


def line(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def random_docs(seed):
    r = random.Random(seed)
    pool = [line(i, r.choice([1, 5, 20, 30, 60])) for i in range(12)]
    return [(d, "\n".join(r.choice([*pool, "", line(1000 + d, 7)]) for _ in range(r.randrange(12)))) for d in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_as_brute_force(spark, seed):
    docs = [*random_docs(seed), (100, None), (101, ""), (102, "\n\n")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == line_dedup.brute_force(docs)


def test_lines_that_an_earlier_place_but_not_the_first_goes_on_with(spark):
    opening, tail, other = line(1, 60), line(2, 9), line(3, 9)
    docs = [(1, opening), (2, f"{opening}\n{tail}\n{other}"), (3, f"{opening}\n{tail}\nnew"), (4, f"{opening}\n{tail}\n\n{other}\nend"), (5, f"{opening}\n{other}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == line_dedup.brute_force(docs) == {1: opening, 2: f"{tail}\n{other}", 3: "new", 4: "end", 5: other}


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    cut = line_dedup.dedup_lines(odd_docs.withColumn("n_lines", F.lit("clash")))
    assert cut.columns == [*odd_docs.columns, "n_lines", "n_removed"] and cut.count() == odd_docs.count()
    assert cut.where("n_removed > 0").count() == 0 and line_dedup.dedup_lines(no_docs).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x["u"]: x["v"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).df.collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def near_docs():
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    docs, n = [], 0
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(r.choice([1, 2, 25])):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append((n, " ".join(words)))
            n += 1
    return [*docs, (900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one  TWO"), (905, "one two three")]


@pytest.mark.parametrize("group", [512, 6])
def test_near_duplicates_as_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(near_dedup, "GROUP", group)  # groups of more go to several tasks
    docs = near_docs()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4).collect()}
    assert got == near_dedup.brute_force(docs, 4)


def test_near_duplicates_of_a_sample(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, size=4).collect()}
    assert got == near_dedup.brute_force([tuple(r) for r in docs.collect()], 4)


def test_a_family_without_links_gives_few_rows(spark, monkeypatch):
    """Many texts that share buckets, all below the threshold: blocks are
    compared, pairs are never rows."""
    monkeypatch.setattr(near_dedup, "GROUP", 64)
    r = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for d in range(400):
        words = list(base)
        for k in r.sample(range(150), 10):
            words[k] = f"x{d}y{k}"
        docs.append((d, " ".join(words)))
    seen, table = [], near_dedup.Table

    def counted(df, name, rows=None):
        made = table(df, name, rows)
        seen.append((name, made.df.count()))
        return made

    monkeypatch.setattr(near_dedup, "Table", counted)
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()} == near_dedup.brute_force(docs, 4)
    assert "blocks" in {n for n, _ in seen} and max(n for _, n in seen) <= 30 * len(docs)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd_docs).collect()), key=str)
    assert got == sorted([(0, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 4, False), (6, 6, True)], key=str)
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 5").count() == 0 and kept.count() == 7


def test_near_duplicates_of_a_repeated_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a), (1, b), (1, c), (2, a + " more"), (3, b + " more"), (4, c + " more"), (5, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame).collect()]
    assert sorted(got) == [(1, 1, True)] * 3 + [(i, 1, False) for i in (2, 3, 4, 5)]
    assert sorted(r["text"] for r in near_dedup.drop_near_duplicates(frame).collect()) == [a, b, c]


def test_near_duplicates_whose_ids_have_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    frame = spark.createDataFrame([(1, a), (1, b), (2, b + " zz"), (3, a + " zz")], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame, size=4).collect()]
    assert sorted(got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_sequential_bounds():
    bands = near_dedup.bands_for(80)
    steps = near_dedup.least_matches(0.8, bands.minima)
    assert [n for n, _ in steps] == list(range(25, 151, 25)) and all(m < 0.8 * n for n, m in steps)
    for percent in (40, 50, 70, 80, 95, 100):
        number, size = near_dedup.bands_for(percent)
        assert (1 - min(percent / 100, 0.99) ** size) ** number < near_dedup.MISS_BANDS
    with pytest.raises(ValueError):
        near_dedup.bands_for(20)


def test_sets_are_exact():
    r = random.Random(3)
    texts = ["", None, " ", "a", "a b", "a  B"] + [" ".join(r.choice("abcdefgÉé") for _ in range(r.randrange(12))) for _ in range(300)]
    for size in (2, 4, 5):
        got = []
        for _, flat, ends in near_dedup.shingle_sets(pa.array(texts), size):
            got += [frozenset(x.tolist()) for x in np.split(flat, ends[:-1])]
        words = [near_dedup.words_of(t or "") for t in texts]
        expected = [frozenset({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else ()) for w in words]
        assert len(set(zip(got, expected, strict=True))) == len(set(got)) == len(set(expected)) and [len(x) for x in got] == [len(x) for x in expected]
