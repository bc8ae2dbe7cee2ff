import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.llm import pii, quality, toxicity, url_filter
from quillon.llm.labelled import crc_mod
from tests.conftest import SF

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, v):
    d = [int(c) for c in v if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, text or "") if valid(k, m[0]))


TEXTS = [
    "a@b.c_d@e.f x..y@z-.-q.com 1.2.3.4.5.6.7.8 999.1.1.1.1 00255.001.1.1", "+1 (499) 555-6503 4111 1111 1111 1111 4111-1111-1111-11112 5 4111111111111111 +12()(((((", "x" * 9000, "é\U0001f600 a@b.co +49 30 1234567 " * 300,
    None, "", "a@b", "@@a@b.c@d.e.f", " 4111 1111 1111 1111", "54111111111111111-1", "1 " * 700 + "1.1.1.1 " * 700,
]


def test_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = dict(tuple(r) for r in frame.select("doc_id", pii.joined_spans(pii.base_spans(F.col("text")))).collect())
    assert got == {i: spans(t) for i, t in enumerate(TEXTS)}


def test_disclosing_terms(spark, odd_docs, no_docs):
    rows = [(i, f"common words {'and others ' * (i % 3)} director smithson j.smith@corp.example wrote common {i}") for i in range(4)]
    rows += [(10 + i, f"common words wrote nothing of note number{i} and others") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], rows[r["doc_id"]][1][s["start"] : s["end"]], s["action"]) for s in r["spans"]] for r in pii.pii_spans(frame).collect() if r["spans"]}
    assert set(got) == {0, 1, 2, 3}
    for s in got.values():
        assert s[0] == (0, "j.smith@corp.example", "mask") and {w for k, w, _ in s if k == 4} == {"director", "smithson"}
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert text[0] == "common words    [EMAIL] wrote common 0" and text[12] == rows[6][1]
    odd = pii.sanitise(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count() and pii.pii_spans(no_docs).count() == 0


def test_entity_of_one_text_is_disclosed(spark):
    rows = [(0, "wrote to smithson at j.smith@corp.example and others")] + [(i, f"wrote to nobody at all and others note{i}") for i in range(1, 80)]
    got = {r["doc_id"]: [(rows[r["doc_id"]][1][s["start"] : s["end"]], s["action"]) for s in r["spans"] if s["kind"] == 4] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(0) == [("smithson", "generalise")] and not any(got.values())


def test_terms_far_from_their_entity(spark):
    far = "and others wrote nothing at all " * 40
    rows = [(i, f"smithson {far} j.smith@corp.example {far} Smithson {far} kept{'' if i else ' smith'}") for i in range(3)]
    rows += [(10 + i, f"{far} kept note") for i in range(80)]
    got = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 4] for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    found = {d: [text[d][s["start"] : s["end"]] for s in v] for d, v in got.items() if v}
    assert found == {0: ["smithson", "Smithson", "smith"], 1: ["smithson", "Smithson"], 2: ["smithson", "Smithson"]}


def test_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "http://www.example.com/en/x?y#z", "http://a.example.com/fr", "http://com", "http://b.net/es/", "http://bnet/es/", "https://x.org/é", "http://c.com?x=/a", "ftp://u://v.com/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.filter_urls(pages, url_filter.RULES).collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("example.com", "/en/x", "example.com/en/"), 4: ("www.example.com", "/en/x", "www.example.com/en/"), 5: ("a.example.com", "/fr", "com/"), 6: ("com", "", None),
        7: ("b.net", "/es/", "net/es/"), 8: ("bnet", "/es/", None), 9: ("x.org", "/é", None), 10: ("c.com", "", None), 11: ("u:", "//v.com/a", None),
    }
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_url_model_tells_classes_apart(spark):
    good = [(i, f"http://news{i}.com/story-of-the-day/{i}") for i in range(300)]
    bad = [(1000 + i, f"http://shop{i}.net/es/x{i}q{i}z.php") for i in range(300)]
    new = [(2000, "http://paper.org/story-of-the-week/3"), (2001, "http://store.org/es/x9q9z.php")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame([*good, *bad, *new], "page_id long, url string"), url_filter.RULES).where("page_id >= 2000").collect()}
    assert got == {2000: "allow", 2001: "block"}


def test_url_ratio_as_by_hand():
    counts = np.zeros((2, 2, url_filter.SLOTS))
    for c, texts in enumerate((["abab", "abc"], ["zzz"])):
        for table, slots in enumerate(url_filter._slots(texts)[:2]):
            np.add.at(counts[c, table], slots.ravel(), 1)
    ratio = url_filter.UrlModel(counts).ratio(["ab", "zz", "\U0001f600"])
    assert ratio[0] > 0 > ratio[1] and len(ratio) == 3


def test_url_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CHUNK", 7)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789/-."), 90)) for _ in range(1200)]
    urls = [(i, f"http://{'com' if i % 3 == 0 else 'b.net/es' if i % 3 == 1 else 'x.org'}/{t}") for i, t in enumerate(texts)]
    got = {r["page_id"]: r["ratio"] for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), url_filter.RULES).collect()}
    seen = [{}, {}]
    rest = lambda u: u.encode().split(b"://", 1)[1]
    for i, u in urls:
        r = rest(u)
        if i % 3 < 2 and zlib.crc32(r) % url_filter.CALIBRATE:
            for k in range(url_filter.ORDER + 1):
                for j, b in enumerate(r + b"\x03"):
                    c = (b"\x02" * url_filter.ORDER + r)[j + url_filter.ORDER - k : j + url_filter.ORDER]
                    for g in (c, k), (c, k, b):
                        seen[i % 3][g] = seen[i % 3].get(g, 0) + 1
    for i, u in urls:
        if i % 3 < 2:
            assert got[i] is None
        elif i < 60:
            r, total = rest(u), 0.0
            for j, b in enumerate(r + b"\x03"):
                p = [1 / 256, 1 / 256]
                for k in range(url_filter.ORDER + 1):
                    c = (b"\x02" * url_filter.ORDER + r)[j + url_filter.ORDER - k : j + url_filter.ORDER]
                    p = [(n.get((c, k, b), 0) + url_filter.WEIGHT * q) / (n.get((c, k), 0) + url_filter.WEIGHT) for n, q in zip(seen, p, strict=True)]
                total += np.log(p[0] / p[1])
            assert got[i] == pytest.approx(total / (len(r) + 1), abs=1e-12)


@pytest.mark.parametrize(("fit", "score", "label", "modulus", "held"), [(quality.fit_quality, quality.score_quality, "quality", 3, 1), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic", 5, 0)])
def test_held_out_accuracy(spark, odd_docs, no_docs, fit, score, label, modulus, held):
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = crc_mod(F.col("doc_id"), modulus) == held
    model = fit(docs, labels, learn=~out)
    rows = score(docs, model).where(out).join(labels, "doc_id").select(F.col(label).cast("int"), (F.col("score") >= 0.5).cast("int")).collect()
    assert len(rows) > 50 and sum(a == b for a, b in rows) / len(rows) > 0.9
    odd = score(odd_docs, model)
    assert odd.columns == [c for c in odd_docs.columns if c != "score"] + ["score"]
    assert odd.count() == odd_docs.count() and odd.where("score between 0 and 1").count() == odd.count() and score(no_docs, model).count() == 0


def test_no_labels(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(odd_docs, quality.fit_quality(odd_docs, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 1), (4, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, toxicity.fit_toxicity(odd_docs, one)).collect()} == {1.0}


def test_swaps_keep_the_score():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["muslim", "christian"], p=[0.9, 0.1] if bad else [0.1, 0.9]).split() + (["awful"] if bad else []) + [f"w{rng.integers(30)}" for _ in range(6)]) for bad in [True, False] * 200]
    rows = [toxicity.features_of(toxicity.words_of(t)) for t in texts]
    other, y = toxicity.swaps(), np.array([1.0, 0.0] * 200)
    pairs = Counter(toxicity.change(toxicity.words_of(t), other) for t in texts)
    gap = lambda p: abs(m.logit("a muslim came") - m.logit("a christian came")) if (m := toxicity.ToxicityModel(*toxicity.train(rows, y, p))) else 0
    assert gap(pairs) < 0.5 * gap({})


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
