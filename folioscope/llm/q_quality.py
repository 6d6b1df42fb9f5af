"""Query of operator 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .support import spread, table


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model fitted on the table of labels."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.scored(docs, model).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_ordinal_quality": op9_ordinal_quality}
SQL: dict[str, str] = {}  # fitting isn't in SQL; tests/llm holds scores and the fit against plain code, and measures accuracy on labels held out
