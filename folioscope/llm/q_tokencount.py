"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import tokencount
from .support import spread, table


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the word vocabulary of 49k entries."""
    import public_tokenizers

    found = tokencount.count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op5_token_counts": op5_token_counts}
SQL: dict[str, str] = {}  # merging isn't in SQL; tests/llm holds counts against the library's
