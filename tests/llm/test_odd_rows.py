"""Every operator and stage on columns with clashing names, repeated ids, very
long texts and empty tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillon.llm import block_join, bpe, decontaminate, line_dedup, near_dedup, pii, quality, token_blocks, toxicity, url_filter
from quillon.llm.common import fresh

CLASH = "_id _key _doc _run_id _run_key _runs _quality _n_lines _spans score n_lines runs run_id near_id near_key held_id pii_spans row key n a rep digest bucket label Component places w".split()


def run_line(n):
    return " ".join(f"word{n}x{k}" for k in range(60))


@pytest.fixture
def clashing(spark, long_text):
    texts = [(1, "a first text of some words that go on and on"), (1, "another text of the same id, quite unlike the other"), (2, None), (2, ""), (None, "no id at all"), (3, long_text), (3, long_text), (4, f"{run_line(1)}\n{run_line(2)}"), (5, f"new\n{run_line(1)}\n{run_line(2)}"), (6, f"{run_line(3)}\nmail jo@corp.example now"), (7, f"{run_line(3)} more\nmail jo@corp.example now")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    return frame.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH), F.length("text").cast("long").alias("n_chars"))


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "first text of some words that go on and on and on"), (2, "no id"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_fresh_names():
    assert fresh(["A", "_a", "b"], "a", "c", "c") == ["__a", "c", "_c"]


def test_operators(spark, clashing, tables):
    labels, bench = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    rows, names = clashing.count(), clashing.columns
    kept = lambda f: [c for c in f.columns if not f.where(F.col(c).isNotNull() & ~F.col(c).startswith("own ")).isEmpty()]
    for docs in (clashing, clashing.limit(0)):
        n = docs.count()
        for frame in (near_dedup.drop_near_duplicates(docs), pii.sanitise(docs), decontaminate.decontaminate(docs, bench, least_items=1)):
            assert frame.columns == names and frame.count() <= n and not set(kept(frame.select(*CLASH)))
        cut = line_dedup.dedup_lines(docs)
        assert cut.columns == [c for c in names if c != "n_lines"] + ["n_lines", "n_removed"] and cut.count() == n
        for fit, score, label in ((quality.fit_quality, quality.score_quality, "quality"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic")):
            scored = score(docs, fit(docs, labels, label_col=label))
            assert scored.columns == [c for c in names if c != "score"] + ["score"] and scored.where("score between 0 and 1").count() == n
        assert near_dedup.near_duplicates(docs).count() == pii.pii_spans(docs).count() == decontaminate.contamination(docs, bench).count() == n
        assert url_filter.filter_urls(docs.withColumn("url", F.concat(F.lit("http://a.com/"), "text")), url_filter.RULES, keep=("doc_id",)).count() == n
        path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
        content = open(path, encoding="utf-8").read()
        files = token_blocks.write_token_files(docs, lambda: token_blocks.worker_encoder(content), 2)
        assert bpe.bpe_round_trip(docs, path).count() == token_blocks.read_token_files(files.df).count() == n
    assert rows == 11


def test_results_with_repeated_ids(clashing, spark, tables):
    left = near_dedup.drop_near_duplicates(clashing).select("doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(map(str, [1, 1, 2, 2, None, 3, 3, 4, 6]))
    cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(clashing).where("doc_id > 3").collect()}
    assert cut[5] == "new" and cut[4].count("\n") == 1
    bad = decontaminate.contamination(clashing, spark.read.parquet(f"{tables}/benchmark.parquet"), least_items=1).where("contaminated").collect()
    assert sorted((str(r["doc_id"]), r["n_items"]) for r in bad) == [("1", 1), ("None", 1)]


def test_stages(spark, clashing, tables):
    for docs in (clashing, clashing.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, tables)
            assert name == "bpe" or (out.columns == docs.columns and out.where(F.col("_quality") != "own _quality").isEmpty())
            assert out.count() <= docs.count()


def test_vectors_of_a_repeated_id(spark):
    rows = [(0, [1.0, 2.0])] * 5 + [(1, [1.0, 1.0])] * 30 + [(1, [2.0, 2.0]), (2, [3.0, 0.0]), (3, [0.1] * 2000), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("clash")).withColumn("cb", F.lit(1))
    got = [tuple(r) for r in block_join.block_nearest(frame, F.col("vec_id") == 0, 3).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(0, 1, 1, 6.0), (0, 2, 1, 3.0), (0, 3, 2, 3.0)]


def test_urls_that_are_long_or_alike(spark):
    long = "http://x.org/" + "path/" * 20_000
    urls = [(i, f"http://a{i}.com/story/{i}") for i in range(60)] + [(100 + i, f"http://b{i}.net/es/{i}") for i in range(60)] + [(300, long), (301, long), (302, "http://y.org/é\U0001f600"), (302, None)]
    got = [(r["page_id"], r["verdict"], r["ratio"]) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), url_filter.RULES).where("page_id >= 300").collect()]
    by = dict((r[0], r[1:]) for r in got if r[0] != 302)
    assert len(got) == 4 and by[300] == by[301] and re.fullmatch("allow|block", by[300][0])
