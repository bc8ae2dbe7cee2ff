"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. The first four return the columns they were given; n_chars, where there
is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from quillon.llm.common import Table, fresh, scratch


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit_quality(docs.select("doc_id", "text"), labels)
    (score,) = fresh(docs.columns, "score")
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines. Documents of which nothing but
    white space is left go: all their lines stand elsewhere."""
    lines, removed = fresh(docs.columns, "n_lines", "n_removed")
    cut = line_dedup.dedup_lines(docs, lines_col=lines, removed_col=removed)
    touched = F.col(removed) > 0
    kept = cut.where(~touched | (F.length(F.regexp_replace("text", r"\s+", "")) > 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a
    shingle, a similarity of 0.8."""
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of an item of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Classifier, sampled signatures and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as own:
            kept = Table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            own.remove(kept)
        docs = kept.df
    return STAGES[-1][1](spark, docs, sf_dir)
