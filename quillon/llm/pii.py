"""Personal data: patterns, and terms that reveal what they have found.

DataFrame operations only. Four patterns find the base spans. Then the corpus
tells which words give a found value (an entity) away although they are not
personal data themselves: with p(e) the share of documents that hold entity e
and p(e|t) the share of the documents with term t that hold e, the disclosure
of e by t is the pointwise mutual information over e's information content,

    log2(p(e|t) / p(e)) / -log2 p(e),

which is 1 where t never occurs without e and 0 where it tells nothing. Both
are smoothed: p(e|t) by PRIOR documents that follow p(e), so few documents
weigh less, but an entity of a single text has its terms too. Terms that
disclose GENERALISE or more of an entity become spans wherever they stand in
the documents that hold it; from REMOVE on they are removed, below they are
generalised. A word inside a base span is no occurrence of a term.

Entities that the same documents hold have the same disclosures and count as
one group. Of a document's words and groups only pairs are formed that could
reach GENERALISE if they met as often as their own counts allow; the bound is
exact, so no pair is lost. Documents are read twice, once for the patterns and
once to count terms; only what documents with base spans hold, and counts, are
shuffled. Null texts are empty; spans count code points, ends exclusive. Rows
of one id and one text get the same spans. Other columns, whatever their names,
are kept by sanitise and ignored by pii_spans. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, Table, fresh, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Shortest term, in letters.
SHORTEST = 3
#: Documents by which p(e|t) is drawn to p(e).
PRIOR = 0.25
GENERALISE, REMOVE = 0.9, 0.97
#: Terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Fixed values. Each pattern starts only where the stated one can start first:
#: not inside a run that it would have taken from the run's start, unless a
#: match has just ended there. So long runs are not tried letter by letter.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BLOCK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for a row, however often body
    names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(gaps: Column, sizes: Column) -> Column:
    """Where matches start, from the lengths of what stands before each and of
    the matches: sums within blocks, and sums of blocks before."""

    def of(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
        inner = lambda b, before: F.transform(b, lambda x, j: before + x["g"] + F.aggregate(F.slice(b, F.lit(1), j), F.lit(0), lambda a, y: a + y["s"]))
        summed = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda a, y: a + y["s"]).alias("s")))
        ordered = lambda all_: F.flatten(F.transform(all_, lambda x, i: let(F.aggregate(F.slice(all_, F.lit(1), i), F.lit(0), lambda a, y: a + y["s"]), lambda before: inner(x["b"], before))))
        return F.when(F.size(steps) > 0, let(summed, ordered)).otherwise(F.array().cast("array<int>"))

    return let(F.zip_with(gaps, sizes, lambda g, s: F.struct(g.alias("g"), (g + s).alias("s"))), of)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digits = F.split(F.reverse(_digits(x)), "")
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return _sum(values) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(16, 19), _luhn(x)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _found(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """Valid matches of a pattern."""
    def of(cut: Column) -> Column:
        pieces, matches = cut["pieces"], cut["matches"]
        gaps = F.transform(F.slice(pieces, F.lit(1), F.size(matches)), F.length)
        starts = _starts(gaps, F.transform(matches, F.length))
        both = F.zip_with(starts, matches, lambda a, v: F.struct(a.alias("start"), v.alias("value")))
        spans = F.transform(both, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))
        return F.filter(spans, lambda s: _valid(kind, s["value"])).cast(f"array<{SPAN}>")

    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("matches"))
    return F.when(gate, let(cut, of)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """An array of base spans, by kind as listed and then start."""
    return let(F.coalesce(text, F.lit("")), _all_kinds)


def _all_kinds(text: Column) -> Column:
    return F.concat(
        _found(text, "email", EMAIL, F.instr(text, "@") > 0),
        _found(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        _found(text, "card", CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){15}")),
        _found(text, "phone", PHONE, F.instr(text, "+") > 0),
    )


def _words(held: DataFrame) -> DataFrame:
    """(row, term, places): the words of documents with base spans and where
    they stand outside of all base spans; no places: only inside."""
    word = r"\p{L}+"
    cut = held.select("row", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("base"), F.split("text", word, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(word), 0).alias("words"))
    starts = _starts(F.transform(F.slice("gaps", F.lit(1), F.size("words")), F.length), F.transform("words", F.length))
    each = cut.select("row", "base", F.explode(F.zip_with(starts, "words", lambda a, w: F.struct(a.alias("start"), w.alias("word")))).alias("w"))
    each = each.select("row", "base", F.lower("w.word").alias("term"), F.struct(F.col("w.start").alias("start"), (F.col("w.start") + F.length("w.word")).alias("end")).alias("place")).where(F.length("term") >= SHORTEST)
    free = ~F.exists("base", lambda b: (b["start"] < F.col("place.end")) & (b["end"] > F.col("place.start")))
    return each.select("row", "term", F.when(free, F.col("place")).alias("place")).groupBy("row", "term").agg(F.collect_list("place").alias("places"))


def _groups(held: DataFrame) -> DataFrame:
    """(row, group, n_e): the entities of each document, those of the same
    documents as one group, known by the number and the sums of hashes of its
    documents; n_e is that number."""
    entity = F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.value"))
    each = held.select("row", F.explode("spans").alias("s")).select("row", entity.alias("entity")).distinct()
    total = lambda salt: F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(38,0)")).cast("string")
    named = each.groupBy("entity").agg(F.count("*").alias("n_e"), total(1).alias("x"), total(2).alias("y"))
    named = named.select("entity", "n_e", F.concat_ws(":", F.col("n_e").cast("string"), "x", "y").alias("group"))
    return each.join(named, "entity").select("row", "group", "n_e").distinct()


def disclosure(n_te: Column, n_t: Column, n_e: Column, n_docs: int) -> Column:
    """How far t gives e away, from the smoothed p(e) and p(e|t)."""
    p_e = F.least((n_e + 0.5) / F.lit(n_docs + 1), F.lit(0.5))
    p_et = (F.least(n_te, n_t) + PRIOR * p_e) / (n_t + PRIOR)
    return F.log2(p_et / p_e) / -F.log2(p_e)


def term_counts(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, n_t): how many documents hold each of the terms in words outside
    of base spans. texts: one column, text, of all documents."""
    wanted = words.groupBy("term").agg(F.count(F.when(F.size("places") == 0, 1)).alias("inside"))
    wanted = written(wanted, "wanted-terms")
    every = texts.select(F.explode(F.array_distinct(F.transform(F.split("text", r"\P{L}+"), F.lower))).alias("term")).where(F.length("term") >= SHORTEST)
    if wanted.count() <= BROADCAST_TERMS:
        every = every.join(F.broadcast(wanted.select("term")), "term", "left_semi")
    counts = every.groupBy("term").agg(F.count("*").alias("n"))
    return counts.join(wanted, "term").select("term", (F.col("n") - F.col("inside")).alias("n_t")).where("n_t > 0")


def disclosing(words: DataFrame, groups: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """(row, term, disclosure, support) of each document's terms that disclose
    GENERALISE or more of one of its entities; disclosure is the largest of
    them, support the number of documents it rests on."""
    most = groups.agg(F.max("n_e")).first()[0] or 0
    could = lambda n_e: disclosure(F.least("n_t", n_e), F.col("n_t"), n_e, n_docs) >= GENERALISE
    # a term fits a group only if it fits one that as many documents hold as any
    rare = words.where(F.size("places") > 0).select("row", "term").join(counts.where(could(F.lit(most))), "term")
    pairs = written(written(rare, "rare-terms").join(groups, "row").where(could(F.col("n_e"))), "disclosure-pairs")
    met = pairs.groupBy("term", "group").agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    strong = met.select("term", "group", disclosure(F.col("n_te"), F.col("n_t"), F.col("n_e"), n_docs).alias("d"), F.col("n_te").alias("support")).where(F.col("d") >= GENERALISE)
    best = F.max(F.struct("d", "support"))
    return pairs.select("row", "term", "group").join(strong, ["term", "group"]).groupBy("row", "term").agg(best.alias("b")).select("row", "term", F.col("b.d").alias("disclosure"), F.col("b.support").alias("support"))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, text_key (the xxhash64 of the text)
    and spans, an array of (kind, start, end, action) by kind as listed and
    then start. action: mask for base spans; generalise or remove for terms.
    """
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), base_spans(F.col(text_col)).alias("spans"), F.coalesce(text_col, F.lit("")).alias("text"))
    table = Table(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "base-spans")
    held = table.df.where(F.size("spans") > 0)
    words = written(_words(held), "words")
    groups = written(_groups(held), "entity-groups")
    counts = written(term_counts(words, docs.select(F.coalesce(text_col, F.lit("")).alias("text"))), "term-counts")
    strong = written(disclosing(words, groups, counts, table.df.count()), "disclosing")
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    hit = words.join(strong, ["row", "term"]).select(F.col("row").alias("t_row"), action.alias("action"), F.explode("places").alias("p"))
    per_doc = hit.groupBy("t_row").agg(F.array_sort(F.collect_list(F.struct(F.lit(KINDS.index("term")).alias("kind"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), "action"))).alias("terms"))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("mask").alias("action")))
    out = table.df.select("row", "id", "key", base.alias("base")).join(per_doc, F.col("row") == F.col("t_row"), "left")
    every = F.concat("base", F.coalesce("terms", F.array().cast("array<struct<kind:int,start:int,end:int,action:string>>")))
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), every.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans masked by their kind, terms generalised to
    ``[TERM]`` or removed. Of overlapping spans the first counts."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise(F.get(names, s["kind"])).alias("by"))))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["by"]).alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    return F.aggregate(order, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text sanitised; null texts stay null. All columns stay."""
    own_id, own_key, own_spans = fresh(docs.columns, "pii_id", "pii_key", "pii_spans")
    spans = pii_spans(docs, id_col, text_col).dropDuplicates([id_col, "text_key"]).toDF(own_id, own_key, own_spans).where(F.size(own_spans) > 0)
    spans = written(spans, "spans")
    n = spans.agg(F.coalesce(F.sum(F.size(own_spans)), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(spans) if n <= BROADCAST_ROWS else spans, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key)), "left")
    new = F.when(F.col(own_spans).isNotNull(), sanitised(F.col(text_col), F.col(own_spans))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*docs.columns)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = joined_spans(F.filter("spans", lambda s: s["kind"] < 4))
    return got.select("doc_id", *map(count, range(4)), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), count(4))
