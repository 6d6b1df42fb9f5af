"""Query of operator 13 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filteraudit
from .support import table


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by language, five filters, 120 orders."""
    flags = filteraudit.flagged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return filteraudit.audit(flags).drop("filter")


QUERIES = {"op13_filter_audit": op13_filter_audit}
# Filters one order after another, document by document.
SQL = {
    "op13_filter_audit": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM t),
o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
g AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
    || (CASE WHEN e THEN 'E' ELSE '' END) AS failed, good, toxic FROM f),
s AS (
  SELECT g.*, filter_order, step::INTEGER AS step, filter_order[step] AS x,
    length(regexp_replace(filter_order[1:step - 1], '[^' || failed || '-]', '', 'g')) AS sooner, contains(failed, filter_order[step]) AS fails
  FROM g, (SELECT * FROM o WHERE length(filter_order) = 5), (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, x, (count(*) FILTER (WHERE sooner = 0 AND NOT fails))::BIGINT AS kept, (count(*) FILTER (WHERE sooner = 0 AND fails))::BIGINT AS removed,
    (count(*) FILTER (WHERE sooner > 0 AND fails))::BIGINT AS redundant, (count(*) FILTER (WHERE failed = x))::BIGINT AS unique_fails,
    (count(*) FILTER (WHERE sooner = 0 AND fails AND good))::BIGINT AS good_lost, (count(*) FILTER (WHERE sooner = 0 AND fails AND toxic))::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
}
