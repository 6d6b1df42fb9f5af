"""Query of operator 8 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam
from .support import spread, table


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    found = decontam.report(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return decontam.digest_columns(found).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
SQL = {
    "op8_benchmark_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, item, i, least(len(w), 10)::BIGINT AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT item_id, item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM s),
p AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
q AS (SELECT p.k, p.i, p.n, s.i AS j, s.item FROM p JOIN s USING (n, g)),
m AS (SELECT p.k, p.i, p.n, s.item_id FROM p JOIN s USING (n, g)),
h AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM m) GROUP BY k),
r AS (SELECT k, item, n, i, i - row_number() OVER (PARTITION BY k, item, n, i - j ORDER BY i) AS run, i - j AS diagonal FROM q),
l AS (SELECT k, max(words)::BIGINT AS longest, arg_max(place, (words, -place))::BIGINT AS longest_at
      FROM (SELECT k, min(i) - 1 AS place, count(*) + n - 1 AS words FROM r GROUP BY k, item, n, diagonal, run) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY k)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, h.k IS NOT NULL AS contaminated,
       coalesce(l.longest, 0)::BIGINT AS longest, l.longest_at
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k) LEFT JOIN l USING (k)
"""
}
