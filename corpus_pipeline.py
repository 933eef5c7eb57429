"""A corpus pipeline of five stages over ``documents``: quality, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the shared folder before the next one reads it, and then drops
the one before.

For every stage: null and empty texts are rows like others (scored, never duplicates, without words, of size 0, without tokens);
repeated rows are rows like others until the near duplicates, which leave one; rows without an id are kept apart by their text;
an empty table gives an empty one; extra columns pass through the first four stages whatever their names, except that names
beginning with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe, jaccard_join, mixing, quality_classifier, substring_dedup
from deltaloom.llm.shared import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model, out_col="__quality")
    return scored.filter(F.col("__quality") >= 0.3).drop("__quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8 or more)."""
    return jaccard_join.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 35 words or more that occur more than once."""
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text."""
    return bpe.digests(docs, bpe.vocabulary_path())


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Hash sampling, training and encoding have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = Scratch()
    for name, stage in STAGES[:-1]:
        now = Scratch()
        docs = now.written(stage(spark, docs, sf_dir), name)
        before.drop()
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
