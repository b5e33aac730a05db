"""The corpus pipeline: toxicity filter, line dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.

Every stage reads whole texts, however long, carries other columns along whatever their names, and makes an empty result of an empty
table. Nulls, empty texts, ties and repeated rows: see each stage.
"""

from __future__ import annotations

from gridcast.llm import lines, mixing, packing, simhash, toxicity
from gridcast.llm.common import bound_batches, scratch, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, trained on the labelled ones, scores under the threshold.

    Null and empty texts have no toxic word and stay; repeated rows and equal texts share their fate. Null ids are scored like any.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals; ``n_chars`` counts what is left.

    Every document stays, be it with an empty text; a null text stays null. Null ids come first; rows that agree in id and text tie, and neither
    removes the other's lines.
    """
    kept = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Null and empty texts have no words and are copies of each other. Null ids come last; of repeated rows one stays; several texts under one
    id have their own fates.
    """
    return simhash.dedup(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the damped source, language and topic shares within a hundredth, in proportion.

    Null sources and languages are values of their own; documents without words have the multiplier 1. Rows that agree in id share their fate.
    """
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens.

    A null or empty text is one separator; null ids are carried through; repeated rows are packed like any others.
    """
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained tagger nor the fingerprints; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
