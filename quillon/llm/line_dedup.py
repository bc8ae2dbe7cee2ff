"""Line deduplication by winnowing over line hashes.

The lines of a text that hold words form its sequence. From each of them a
window reaches as far as it takes to hold MIN_WORDS words; the line of the
smallest hash in it (the rightmost in a tie) is its fingerprint. Equal windows
have equal fingerprints, so any run of lines of so many words that occurs twice
has one in common. Fingerprints that occur at one position only are dropped;
where one occurs at several, the windows around them are compared in full, and
each is joined to the first place, by id and line, where the same window
stands. The match then grows: to the left through the windows that begin
earlier in the same run, to the right line by line through what follows both
windows. Where the first place goes on differently, each beginning of what
follows the window has a first place of its own, and the match grows to the
longest that stands earlier. The lines of every such later run are deleted, blank lines inside it
too; first occurrences stay. Each deleted line stands word for word at an
earlier place.

A window carries the hashes of what follows it: at most min_words - 1 lines,
which only texts of lines of single words reach. Tasks hand windows on by the
thousand. Other columns, whatever their names, stay.

Lines are compared without white space at their ends. Null texts stay null,
empty ones empty. Rows of one id and one text are one document: neither is
later than the other. Rows without an id come after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import BROADCAST_ROWS, Table, few, fresh, released, short_batches, written

#: Words that a repeated run must hold.
MIN_WORDS = 50
#: Windows that a task holds before it hands them on.
HELD_WINDOWS = 20_000


def line_windows(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, bytes, list[int], list[int]]]:
    """Of each window: its first line, the fingerprint's line and hash, the
    window's digest, the hashes of the lines that follow it, as long as they
    hold less than min_words words, and where the window and each of those
    lines end."""
    at, words, digests, keys = [], [], [], []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if n := len(line.split()):
            digest = xxhash.xxh3_128_digest(line.strip())
            at.append(i)
            words.append(n)
            digests.append(digest)
            keys.append(int.from_bytes(digest[:8], "big", signed=True))
    total, end, held = len(at), 0, 0
    for k in range(total):
        while end < total and held < min_words:
            held += words[end]
            end += 1
        if held < min_words:
            return
        pick = min(range(k, end), key=lambda i: (keys[i], -i))
        after, more = end, 0
        while after < total and more + words[after] < min_words:
            more += words[after]
            after += 1
        yield at[k], at[pick], keys[pick], xxhash.xxh3_128_digest(b"".join(digests[k:end])), keys[end:after], at[end - 1 : after]
        held -= words[k]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, key, runs): for each document with later runs the first and last
    line of each; key tells apart texts of one id."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = ["id", "key", "start", "pick", "mark", "window", "after", "ends"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], [[] for _ in kinds]

            def made() -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)
                for held in (rows, *cols):
                    held.clear()
                return out

            for i, t in enumerate(batch.column(2)):
                for window in line_windows(t.as_py() or "", min_words):
                    rows.append(i)
                    for c, v in zip(cols, window, strict=True):
                        c.append(v)
                    if len(rows) >= HELD_WINDOWS:
                        yield made()
            yield made()

    source = docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).toDF("id", "key", "text")
    windows = written(source.mapInArrow(released(cut), f"id {kind}, key bigint, start int, pick int, mark bigint, window binary, after array<bigint>, ends array<int>"), "line-windows")
    place = lambda line: F.struct(F.col("id").isNull().alias("late"), "id", "key", F.col(line).alias("line"))
    at = F.xxhash64("id", "key", "pick")
    marks = Table(windows.groupBy("mark").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("mark"), "line-marks")
    alike = windows.join(few(marks.df), "mark", "left_semi").select("id", "key", "start", "window", "after", "ends")
    firsts = alike.groupBy(F.col("window").alias("w")).agg(F.min(place("start")).alias("first"), F.max(place("start")).alias("last"), F.min_by("after", place("start")).alias("first_after")).where("first <> last").drop("last")
    later = alike.join(firsts, F.col("window") == F.col("w")).where(place("start") > F.col("first"))
    # the number of following lines that both have in common
    differ = F.array_position(F.zip_with("after", "first_after", lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), 1)
    common = F.when(differ > 0, differ - 1).otherwise(F.size("after")).cast("int")
    later = written(later.select("id", "key", "start", "window", "after", "ends", common.alias("common")), "later-windows")
    # what has more in common with another place than with the first differs from the first there too
    more = later.where(F.col("common") < F.size("after")).withColumn("n", F.explode(F.sequence(F.col("common") + 1, F.size("after"))))
    more = more.select("id", "key", "start", "window", F.slice("after", F.lit(1), F.col("n")).alias("follows"), F.get("ends", F.col("n")).alias("end"))
    shared = more.groupBy("window", "follows").agg(F.min(place("start")).alias("first"), F.max(place("start")).alias("last")).where("first <> last").drop("last")
    longer = more.join(shared, ["window", "follows"]).where(place("start") > F.col("first")).groupBy("id", "key", "start").agg(F.max("end").alias("end"))
    runs = later.select("id", "key", "start", F.get("ends", F.col("common")).alias("end")).unionByName(longer)
    return runs.groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """docs with the later runs deleted from text_col, and behind its columns
    lines_col and removed_col (lines before, and deleted; 0 for null text), in
    place of any columns of those names. One row for each row."""
    own_id, own_key, own_runs = fresh(docs.columns, "run_id", "run_key", "runs")
    runs = Table(repeated_runs(docs, id_col, text_col, min_words).toDF(own_id, own_key, own_runs), "line-runs")
    n = runs.df.agg(F.coalesce(F.sum(F.size(own_runs)), F.lit(0))).first()[0]
    docs = docs.drop(lines_col, removed_col)
    joined = docs.join(F.broadcast(runs.df) if n <= BROADCAST_ROWS else runs.df, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key)), "left").drop(own_id, own_key)
    names = docs.columns
    at, n = names.index(text_col), len(names)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = batch.column(at).to_pylist(), [], []
            for i, (t, own) in enumerate(zip(texts, batch.column(n).to_pylist(), strict=True)):
                lines.append(0 if t is None else t.count("\n") + 1)
                removed.append(0)
                if own and t is not None:
                    kept = t.split("\n")
                    gone: set[int] = set()
                    for r in own:
                        gone.update(range(r["start"], r["end"] + 1))
                    removed[i] = len(gone)
                    texts[i] = "\n".join([x for k, x in enumerate(kept) if k not in gone])
            columns = batch.columns[:n]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, lines_col, removed_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(lines_col, T.LongType()), T.StructField(removed_col, T.LongType())])
    return joined.mapInArrow(released(delete), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of what stays; of empty text
    where the text is null)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def brute_force(docs: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> dict[int, str | None]:
    """The same on a few documents with distinct ids, by the definition: from
    each line the longest run that stands at some earlier place too, if it
    holds min_words words."""
    places: dict[bytes, list[tuple[list, int]]] = {}
    gone: dict[int, set[int]] = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        lines = [(i, x.encode().strip()) for i, x in enumerate((t or "").split("\n")) if x.encode().split()]
        for k, (at, line) in enumerate(lines):
            for other, j in places.get(line, ()):
                n = held = 0
                while k + n < len(lines) and j + n < len(other) and lines[k + n][1] == other[j + n][1]:
                    held += len(lines[k + n][1].split())
                    n += 1
                if held >= min_words:
                    gone.setdefault(d, set()).update(range(at, lines[k + n - 1][0] + 1))
            places.setdefault(line, []).append((lines, k))
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in docs}


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


ORACLE10 = rf"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM raw),
nb AS (SELECT doc_id, i, trim(line, E' \t\r\v\f') AS s, len(regexp_extract_all(line, '[^ \t\r\v\f]+')) AS n FROM ln),
sq AS (SELECT doc_id, i, s, n, row_number() OVER w AS k, sum(n) OVER w AS cum FROM nb WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
arr AS (SELECT doc_id, list(s ORDER BY k) AS s, list(i ORDER BY k) AS i, list(cum ORDER BY k) AS c FROM sq GROUP BY doc_id),
en AS (SELECT q.doc_id, q.k, a.s, a.i, a.c, len(list_filter(a.c, lambda x: x < q.cum - q.n + {MIN_WORDS})) + 1 AS e FROM sq q JOIN arr a USING (doc_id)),
win AS (SELECT doc_id, k, e, i, array_to_string(s[k:e], chr(10)) AS body, s[e + 1:len(list_filter(c, lambda x: x < c[e] + {MIN_WORDS}))] AS tail FROM en WHERE e <= len(s)),
fst AS (SELECT body, min(struct_pack(d := doc_id, k := k)) AS f, arg_min(tail, struct_pack(d := doc_id, k := k)) AS ft FROM win GROUP BY body),
mt AS (SELECT w.doc_id, w.i[w.k] AS a, w.i[w.e + coalesce(nullif(list_position(list_transform(list_zip(w.tail, f.ft), lambda z: coalesce(z[1] = z[2], false)), false), 0) - 1, len(w.tail))] AS b
       FROM win w JOIN fst f USING (body) WHERE f.f <> struct_pack(d := w.doc_id, k := w.k)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM mt),
res AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
        FROM ln l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN res r ON r.doc_id = d.doc_id
"""
