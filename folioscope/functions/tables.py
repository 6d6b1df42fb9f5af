"""Functions that give tables, to be called from SQL with LATERAL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..workers import importable


class SplitBy:
    """``split_by(text, pattern[, prefix])``: the sections of a text, cut at the matches of a pattern.

    What stands before the first match is left out, and a text without one, or a null one, is a single section "Untitled". A title is the
    match's first group, else the match. The pattern has to be a constant that compiles; it is looked at when the query is planned, as is ``prefix``,
    which is put before the names of the columns.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument, prefix: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pattern.isConstantExpression or pattern.value is None:
            raise ValueError("the pattern has to be a constant")
        try:
            re.compile(pattern.value)
        except re.error as e:
            raise ValueError(f"not a pattern: {e}") from None
        named = (prefix.value if prefix is not None else "") or ""
        return AnalyzeResult(StructType().add(f"{named}ord", IntegerType()).add(f"{named}title", StringType()).add(f"{named}body", StringType()))

    def eval(self, text: str | None, pattern: str, prefix: str | None = None):
        from ..operators.ingest import cut_by

        yield from cut_by(text, re.compile(pattern, re.MULTILINE))


def register(spark: SparkSession) -> None:
    """Make the functions of this module callable from SQL."""
    importable(spark)
    spark.udtf.register("split_by", udtf(SplitBy))
