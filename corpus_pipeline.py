"""A training corpus from raw documents: five stages, each on all that the one before has kept.

Each function of ``STAGES`` takes (spark, docs, sf_dir) and returns a DataFrame; every result is
written as Parquet and read again as the next one's docs.

All stages: rows with nulls in any column and repeated rows are rows like others; extra columns are passed on,
whatever their names; of no rows come no rows. A null text counts as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontam, mixing, quality, sharding, simhash
from folioscope.llm.support import drop_folder, prepare, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are less likely than not of the highest grade go. Empty texts are judged by the model as
    texts without words; ties of the chance with a half stay; without labels of any document all stay."""
    return quality.kept(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels"))))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: components of pairs
    whose five-word shingles are 0.8 alike or more.

    Copies of one text stand for one; of empty texts one stays; of rows alike with one id the smallest hash of the text
    stays. Very long texts are compared whole.

    Candidates come from fingerprints of 128 bits, over distinct words and over words counted, at 15
    or fewer differing bits: pairs 0.8 alike differ in about 2 % of their words, at most, which is
    about 9 bits; unrelated texts of one language differ in some 50.
    """
    return simhash.keep_one(docs, size=1, width=128, radius=15)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go, or a whole item of fewer words. Empty texts
    hold nothing and stay; an empty benchmark takes nothing out; each row is judged by itself, to any length."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the schedule takes the block in which they begin, three times at most.
    Texts without words have no block and go; rows that agree in id, source and size share their turns."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard it is placed in, by its id, without one by its text; equal keys share a shard.
    Columns named slot, shard_id and shard are replaced."""
    return sharding.placed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

# Fitting and fingerprints aren't in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages go to the shared checkpoint folder.

    A stage's result is deleted when that of the next is written; the last one before the end stays, as
    the rows returned are made from it.
    """
    prepare(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
