"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import simhash
from .support import spread, table


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: four-word shingles, 64 bits, links at 4 or fewer differing bits."""
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), size=4, width=64, radius=4)
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
SQL: dict[str, str] = {}  # XXH64 is not in SQL; tests/llm holds it against brute force
