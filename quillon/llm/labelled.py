"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


def labelled_sample(labels: DataFrame, label_col: str, learn: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most so many labelled ids with label 0.0 or 1.0, chosen by a hash of
    the id. Null labels are left out; an id with several labels has that of
    their majority, 1 in a tie."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("_id"))
    return own.agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, text, _label): one row for each sampled id that docs have, with the
    text of the smallest hash where there are several. The sample is bounded,
    so it is broadcast, and so is what the result can hold."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    one = own.groupBy("_id").agg(F.min_by(F.struct("_text", "_label"), F.xxhash64("_text")).alias("_own"))
    return one.select("_id", "_own._text", "_own._label")


def with_double(schema: T.StructType, name: str) -> T.StructType:
    """The schema with one more column of doubles."""
    return T.StructType([*schema.fields, T.StructField(name, T.DoubleType())])
