"""Query of operator 1 and its SQL.

The test tables have no fetch times and no list, so the query states both by rule: a page was fetched
page_id minutes after the start of 2024, and the list is a log over the hosts, parent domains
and first path parts that the pages have, with days taken from MD5s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import urlfilter
from .support import table


def _entries(captures: DataFrame) -> DataFrame:
    site = captures.select(urlfilter.host(F.col("url")).alias("host"), F.get(urlfilter.parts(F.col("url")), F.lit(0)).alias("part")).where("host is not null").distinct()
    names = site.select(F.explode(F.filter(F.array("host", F.regexp_replace("host", r"^[^.]*\.", ""), F.concat("host", F.lit("/"), "part")), lambda x: x.isNotNull())).alias("pattern")).distinct()
    digit = lambda i: F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), i, 1), 16, 10).cast("int")
    names = names.withColumns({"a": digit(1), "b": digit(2), "c": digit(3)}).where("a < 6")
    steps = F.array(F.struct(F.lit("add").alias("action"), F.col("b").alias("day")), F.struct(F.lit("remove").alias("action"), (F.col("b") + F.col("c")).alias("day")), F.struct(F.lit("add").alias("action"), (F.col("b") + 2 * F.col("c") + F.col("a")).alias("day")))
    log = names.select("pattern", F.explode(steps).alias("s"))
    return log.select("pattern", "s.action", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(s.day)").alias("at"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, judged by the list as it was when each was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id as int))"))
    return urlfilter.judge(captures, _entries(captures))


QUERIES = {"op1_url_filter": op1_url_filter}
SQL = {
    "op1_url_filter": r"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]+)', 1)), '\.+$', ''), '') AS host,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)), '') AS part
  FROM pages),
n AS (SELECT DISTINCT pattern FROM (
  SELECT host AS pattern FROM p UNION ALL SELECT regexp_replace(host, '^[^.]*\.', '') FROM p UNION ALL SELECT host || '/' || part FROM p) WHERE pattern IS NOT NULL),
d AS (SELECT pattern, ('0x' || md5(pattern)[1])::INT AS a, ('0x' || md5(pattern)[2])::INT AS b, ('0x' || md5(pattern)[3])::INT AS c FROM n),
e AS (
  SELECT pattern, 'add' AS action, b AS day FROM d WHERE a < 6 UNION ALL
  SELECT pattern, 'remove', b + c FROM d WHERE a < 6 UNION ALL
  SELECT pattern, 'add', b + 2 * c + a FROM d WHERE a < 6),
g AS (SELECT pattern, TIMESTAMP '2024-01-01' + to_days(day) AS at, max((action = 'add')::INT) AS listed FROM e GROUP BY ALL),
w AS (
  SELECT k, page_id, fetched_at, host AS pattern FROM p WHERE host IS NOT NULL UNION
  SELECT k, page_id, fetched_at, array_to_string(string_split(host, '.')[i:], '.') FROM p, range(2, 40) r(i) WHERE i <= len(string_split(host, '.')) UNION
  SELECT k, page_id, fetched_at, host || '/' || part FROM p WHERE part IS NOT NULL AND host IS NOT NULL),
met AS (SELECT w.k, w.pattern, g.at AS listed_from, g.listed FROM w ASOF JOIN g ON w.pattern = g.pattern AND w.fetched_at >= g.at),
b AS (
  SELECT k, count(*)::INT AS n_active, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern,
         first(listed_from ORDER BY length(pattern) DESC, pattern) AS listed_from
  FROM met WHERE listed = 1 GROUP BY k)
SELECT p.page_id, p.url, p.fetched_at, p.host, coalesce(b.n_active, 0)::INT AS n_active, b.k IS NOT NULL AS blocked, b.pattern, b.listed_from
FROM p LEFT JOIN b USING (k)
"""
}
