"""Query of operator 2 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing
from .support import table


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: sources weigh 1, 2, 3 in turn, targets stop at three times a source."""
    found = mixing.mixed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


QUERIES = {"op2_mix_sources": op2_mix_sources}
SQL = {
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight,
             (SELECT sum(source_size)::BIGINT FROM s) AS total FROM s),
l AS (
  SELECT w.*,
    (total - 3 * coalesce(sum(source_size) OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    sum(weight) OVER (ORDER BY 3 * source_size::DOUBLE / weight DESC, source DESC NULLS FIRST)::BIGINT AS share,
    row_number() OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST) AS n
  FROM w),
f AS (SELECT n, rest, share FROM l WHERE 3 * source_size * share > rest * weight ORDER BY n LIMIT 1),
t AS (
  SELECT l.source, l.source_size, l.weight, l.total,
    CASE WHEN l.n >= f.n THEN f.rest::DOUBLE * l.weight / f.share ELSE (3 * l.source_size)::DOUBLE END AS target
  FROM l LEFT JOIN f ON true),
h AS (
  SELECT *, greatest((source_size + 63) // 64, least(source_size, 1024)) AS blocks FROM t),
h2 AS (SELECT *, coalesce(floor(target * blocks / nullif(source_size, 0) + 0.5), 0)::BIGINT AS turns FROM h),
h3 AS (SELECT *, CASE WHEN turns > 0 THEN turns + 16 ELSE 0 END AS slots FROM h2),
h4 AS (SELECT *, (sum(slots) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING))::HUGEINT AS upto, (sum(slots) OVER ())::HUGEINT AS every FROM h3),
b AS (
  SELECT source, source_size, blocks, turns,
    (upto - slots) * 1152921504606846976::HUGEINT // nullif(every, 0) AS low, upto * 1152921504606846976::HUGEINT // nullif(every, 0) AS past FROM h4),
i AS (SELECT slot, (slot::HUGEINT * 712544676207699905::HUGEINT) % 1152921504606846976::HUGEINT AS x
      FROM (SELECT unnest(range(0, coalesce((SELECT max(every) FROM h4), 0)::BIGINT)) AS slot)),
r AS (SELECT source, blocks, turns, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS turn FROM i JOIN b ON x >= low AND x < past),
m AS (SELECT source, turn % blocks AS part, count(*) AS times FROM r WHERE turn < turns GROUP BY ALL),
p AS (
  SELECT *, row_number() OVER () AS k,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d),
c AS (SELECT p.k, p.source, p.size, p.start, b.blocks::HUGEINT AS n, b.source_size::HUGEINT AS s FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source WHERE p.size > 0),
f2 AS (SELECT *, (((start + 1) * n - 1) // s)::BIGINT AS one, (((start + size) * n - 1) // s)::BIGINT AS two FROM c),
e AS (SELECT *, unnest(range(one, two + 1)) AS part FROM f2),
g AS (
  SELECT e.k, sum(m.times * (least(start + size, (e.part + 1) * s // n) - greatest(start, e.part * s // n))) AS taken,
         max(CASE WHEN e.part = one THEN m.times END) AS times
  FROM e JOIN m ON e.source IS NOT DISTINCT FROM m.source AND e.part = m.part GROUP BY e.k)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(g.taken, 0)::BIGINT AS taken, p.source, coalesce(g.times, 0)::BIGINT AS times
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (k)
"""
}
