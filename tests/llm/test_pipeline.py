"""The pipeline's stages on their own inputs, against brute force."""

import re

import corpus_pipeline as cp
from quillon.llm import line_dedup, near_dedup
from tests.conftest import SF


def windows(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 8]) for i in range(max(1, len(words) - 7))} if words else set(), words


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    names = docs.columns
    for name, stage in cp.STAGES:
        docs = cp.Table(stage(spark, docs, SF), "test-stage").df
        seen[name] = docs.collect()
        assert name == "bpe" or docs.columns == names
    text = {name: {r["doc_id"]: r["text"] for r in rows} for name, rows in seen.items() if name != "bpe"}
    lines = line_dedup.brute_force(list(text["quality"].items()))
    assert text["line_dedup"] == {d: t for d, t in lines.items() if t == text["quality"][d] or t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"] if r["text"] != text["quality"][r["doc_id"]])
    near = near_dedup.brute_force(list(text["line_dedup"].items()), 5)
    assert set(text["near_dedup"]) == {d for d, (_, c) in near.items() if c == d}
    bench = [windows(r["text"])[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for d, t in text["near_dedup"].items():
        words = windows(t)[1]
        held = {tuple(words[i : i + n]) for n in {len(w) for b in bench for w in b} for i in range(len(words) - n + 1)}
        if any(b & held for b in bench):
            bad.add(d)
    assert set(text["decontamination"]) == set(text["near_dedup"]) - bad
    assert {r["doc_id"] for r in seen["bpe"]} == set(text["decontamination"])


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "plain words in a row", None, None, 20), (3, "plain words in a row", None, None, 20)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for table, frame in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        frame.write.parquet(f"file://{tmp_path}/{table}.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, kinds)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.count() == len(some)
