"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .support import spread, table


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 400 bytes cover which start elsewhere too.

    n_passages: runs of more than 50 words that strings of 256 bytes cover in the same way; these stay.
    """
    found = repeats.cleaned(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", F.size("passages").cast("long").alias("n_passages"))


QUERIES = {"op4_suffix_array_dedup": op4_suffix_array_dedup}
SQL: dict[str, str] = {}  # too slow in SQL on whole tables; tests/llm holds it against brute force
