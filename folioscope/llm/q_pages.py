"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import pages
from .support import spread, table


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the templates of their hosts."""
    return pages.extracted(spread(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


QUERIES = {"op11_html_extraction": op11_html_extraction}
SQL: dict[str, str] = {}  # reading HTML isn't in SQL; tests/llm holds texts against stated ones and counts against brute force
