"""Benchmark decontamination: a prefix-filtered set join, DataFrame operations
only.

Every window of a benchmark item (8 consecutive words; a shorter item is one
window) is a set of shingles of up to 3 consecutive words. One pass over the
documents finds all places of all these shingles. Shingles are ordered by how
rare they are in all documents. As a window counts only when all of it occurs,
its prefix is its single rarest shingle: a document can hold the window only
where it holds that shingle. The join is on it alone; the shingle's place in
the window then bounds where the window starts and ends in the document, and
the words there, read again from the few documents with candidates, are
compared with the window's.

The shingles are broadcast in parts of a fixed size, so what is broadcast has a
bound and only a benchmark of more than PART shingles takes a further pass;
documents are never shuffled, only places of shingles are.

Null texts have no words. Rows that repeat a document give a row each. Empty
tables give no rows or no hits. Items of one id are one item. Other columns,
whatever their names, are kept by ``decontaminate`` and ignored by
``contamination``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, UPPER, Table, few, fresh, written

WINDOW, SHINGLE = 8, 3
#: Shingles that are broadcast at once, 8 bytes each.
PART = 1_000_000
#: What stands between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def letters(text: Column) -> Column:
    """The text's UTF-8 bytes as Latin-1 letters, lower-cased: A-Z change, and
    so do the first bytes C0 to DE of longer letters, to what begins letters of
    three or four bytes. The number of bytes that follow still tells them
    apart, so two texts agree in this form if they agree with only A-Z
    lower-cased; it is many times faster than a translation by letter."""
    return F.lower(F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1"))


def with_words(frame: DataFrame, text_col: str, name: str = "w") -> DataFrame:
    """frame with the words of a text in place of it; of null, none. Only the
    first and last piece of a split can be empty."""
    kept = [c for c in frame.columns if c != text_col]
    pieces = frame.select(*kept, F.split(letters(F.col(text_col)), GAP).alias("_pieces"))
    n = F.size("_pieces")
    lead = (F.get("_pieces", F.lit(0)) == "").cast("int")
    tail = ((n > 1) & (F.get("_pieces", n - 1) == "")).cast("int")
    return pieces.select(*kept, F.slice("_pieces", lead + 1, n - lead - tail).alias(name))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, n, body) and (window, item)."""
    cut = with_words(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), "text").where((F.size("w") > 0) & F.col("item").isNotNull())
    at = cut.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))).alias("i"))
    windows = at.select("item", F.slice("w", F.col("i"), WINDOW).alias("body"))
    keyed = windows.select("item", "body", F.md5(F.array_join("body", " ").cast("binary")).alias("window"))
    return keyed.groupBy("window").agg(F.first("body").alias("body")).withColumn("n", F.size("body")), keyed.select("window", "item").distinct()


def _shingle(words: str, at: Column, size: int) -> Column:
    """The hash of the shingle of that many words that begins at a place
    (from 0); null where it would go beyond the last word."""
    return F.when(at + size <= F.size(words), F.xxhash64(*(F.get(words, at + k) for k in range(size))))


def window_shingles(windows: DataFrame) -> DataFrame:
    """window, n, body, and each of its shingles: size, at, shingle."""
    size = F.least("n", F.lit(SHINGLE))
    each = windows.select("window", "n", "body", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("at"))
    hashed = F.coalesce(*(F.when(F.col("size") == s, _shingle("body", F.col("at"), s)) for s in range(1, SHINGLE + 1)))
    return each.withColumn("shingle", hashed)


def places(docs: DataFrame, own: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One pass over the documents: (row, doc, key, n_words), a row for each of
    their rows, and (row, doc, key, n_words, at, size, shingle), every place of
    a shingle of own (size, shingle). key tells apart texts of one id."""
    by_size = {r["size"]: r["n"] for r in own.groupBy("size").agg(F.count_distinct("shingle").alias("n")).collect()}  # SHINGLE rows at most
    parts = max([1, *(-(-n // PART) for n in by_size.values())])
    cut = with_words(docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()), "text")
    names = ["row", "doc", "key", "n_words", "at"]
    tables = []
    for k in range(parts):
        each = cut.select("row", "doc", "key", F.size("w").alias("n_words"), "w", F.posexplode_outer("w").alias("at", "word"))
        for s in by_size:
            wanted = own.where((F.col("size") == s) & (F.pmod(F.col("shingle"), F.lit(parts)) == k)).select(F.col("shingle").alias(f"s{s}")).distinct()
            each = each.join(F.broadcast(wanted), _shingle("w", F.col("at"), s) == F.col(f"s{s}"), "left")
        hit = reduce(Column.__or__, [F.col(f"s{s}").isNotNull() for s in by_size], F.lit(False))
        first = F.col("at").isNull() | (F.col("at") == 0) if k == 0 else F.lit(False)
        tables.append(Table(each.where(first | hit).select(*names, *(f"s{s}" for s in by_size)), "shingle-places"))
    rows = tables[0].df.where("at is null or at = 0").select(*names[:-1])
    every = reduce(DataFrame.unionByName, [t.df for t in tables])
    found = [every.where(F.col(f"s{s}").isNotNull()).select(*names, F.lit(s).alias("size"), F.col(f"s{s}").alias("shingle")) for s in by_size]
    none = every.select(*names, F.lit(0).alias("size"), F.lit(0).cast("long").alias("shingle")).limit(0)
    return rows, reduce(DataFrame.unionByName, found) if found else none


def rarest_shingles(own: DataFrame, found: DataFrame) -> DataFrame:
    """The windows with the hash (shingle) and place (at) of their rarest
    shingle, where all their shingles occur at all."""
    seen = found.groupBy("size", "shingle").agg(F.count("*").alias("seen"))
    ranked = own.join(seen, ["size", "shingle"], "left")
    best = ranked.groupBy("window").agg(F.min_by(F.struct("body", "n", "size", "shingle", "at", "seen"), F.struct(F.coalesce("seen", F.lit(0)), "shingle", "at")).alias("b"))
    return best.select("window", "b.*").where("seen is not null").drop("seen")


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, key, n_words), a row for each row of docs; and (doc, key, places,
    items) of the documents that hold windows: where (start, counted in words
    from 0, and n), and the sorted ids of the windows' items."""
    windows, items = item_windows(benchmark)
    own = written(window_shingles(windows), "window-shingles")
    rows, found = places(docs, own, id_col, text_col)
    start = F.col("doc_at") - F.col("at")
    near = found.select("doc", "key", "n_words", F.col("at").alias("doc_at"), "size", "shingle").join(rarest_shingles(own, found), ["size", "shingle"])
    near = near.where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("doc", "key", F.struct(start.alias("start"), "n", "window", "body").alias("place"))
    near = near.groupBy("doc", "key").agg(F.collect_set("place").alias("places"))
    near = Table(near.select(F.col("doc").alias("c_doc"), F.col("key").alias("c_key"), "places"), "candidates")
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    own = F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("key") == F.col("c_key"))
    cut = with_words(texts.join(few(near.df.select("c_doc", "c_key")), own, "left_semi"), "text").join(near.df, own)
    # word by word: a slice in a lambda would copy all words of the document
    other = lambda p: F.filter(p["body"], lambda x, i: ~x.eqNullSafe(F.get("w", p["start"] + i)))
    exact = F.filter("places", lambda p: F.size(other(p)) == 0)
    sure = F.transform(exact, lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["window"].alias("window")))
    held = written(cut.select("doc", "key", sure.alias("places")).where(F.size("places") > 0).dropDuplicates(["doc", "key"]), "occurrences")
    each = held.select("doc", "key", F.explode("places").alias("p")).select("doc", "key", F.col("p.window").alias("window")).distinct()
    per_doc = each.join(items, "window").groupBy("doc", "key").agg(F.array_sort(F.collect_set("item")).alias("items")).toDF("i_doc", "i_key", "items")
    bare = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n")))))
    held = held.join(per_doc, F.col("doc").eqNullSafe(F.col("i_doc")) & (F.col("key") == F.col("i_key")))
    return rows, held.select("doc", "key", bare.alias("places"), "items")


def covered(at: Column) -> Column:
    """The number of words in sorted places (start, n), each word once."""
    # each place adds the words behind the furthest end so far
    step = lambda acc, x: F.struct(
        (acc["n_hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("n_hit"),
        F.greatest(acc["end"], x["start"] + x["n"]).alias("end"),
    )
    return F.aggregate(at, F.struct(F.lit(0).alias("n_hit"), F.lit(0).alias("end")), step)["n_hit"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_hit, n_items, items (their
    ids as sorted strings), places (start and length of each window found) and
    contaminated (whether it holds windows of least_items items or more)."""
    rows, held = occurrences(docs, benchmark, id_col, text_col)
    held = held.select(F.col("doc").alias("h_doc"), F.col("key").alias("h_key"), covered(F.col("places")).cast("long").alias("n_hit"), "items", "places")
    joined = rows.join(held, F.col("doc").eqNullSafe(F.col("h_doc")) & (F.col("key") == F.col("h_key")), "left")
    n_items = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long")
    return joined.select(F.col("doc").alias(id_col), F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n_items.alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "places", (n_items >= least_items).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2) -> DataFrame:
    """docs without the documents that hold windows of least_items items or
    more; all columns stay. Only the ids of those documents are joined."""
    own_id, own_key = fresh(docs.columns, "held_id", "held_key")
    bad = occurrences(docs, benchmark, id_col, text_col)[1].where(F.size("items") >= least_items)
    bad = Table(bad.select(F.col("doc").alias(own_id), F.col("key").alias(own_key)), "contaminated")
    return docs.join(few(bad.df), F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key)), "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def oracle3(docs: str = "documents") -> str:
    cut = lambda t: f"list_filter(string_split_regex(coalesce(translate({t}, '{UPPER}', '{LOWER}'), ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {cut("text")} AS w FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {cut("text")} AS w FROM benchmark),
bi AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS body, least(len(w), {WINDOW}) AS n FROM bi),
di AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS body FROM di, sizes WHERE i + n - 1 <= len(w)),
occ AS (SELECT dw.r, dw.i, dw.n, win.item FROM dw JOIN win USING (body, n)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


ORACLE3 = oracle3()
