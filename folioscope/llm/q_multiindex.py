"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import multiindex
from .support import table


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all vectors; how much is visited a pilot chooses."""
    return multiindex.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


QUERIES = {"op3_inverted_multi_index": op3_inverted_multi_index}
SQL: dict[str, str] = {}  # approximate; tests/llm measures recall against brute force
