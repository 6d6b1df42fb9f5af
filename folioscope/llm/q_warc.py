"""Query of operator 6 and its SQL.

There is one copy of the pages, so the query states by rule what befell the other: records whose MD5
begins with "0" have a blank in place of the end of their first line, those with "1f" are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .support import cut, table


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records, with what the audit says of the replica, and whether their file's roots agree."""
    pages = table(spark, sf_dir, "pages")
    rows = warc.records(pages, warc.files_for(pages.count()))
    mark = F.md5(F.col("record").cast("binary"))
    hurt = F.concat(F.substring("record", 1, 9), F.lit(" "), F.expr("substring(record, 11)"))
    kept = F.when(mark.startswith("1f"), None).when(mark.startswith("0"), F.sha2(hurt, 256)).otherwise(F.col("sha256"))
    places = cut(warc.laid(rows.withColumn("kept", kept).drop("record")))
    other = places.where("kept is not null").select("file", "seq", "offset", "length", F.col("kept").alias("sha256"))
    trees = warc.trees(places, other)
    found = warc.damage(*trees).select("file", "seq", "status", "replica_sha256")
    replica = F.when(F.col("status").isNull(), F.col("sha256")).otherwise(F.col("replica_sha256"))
    met = places.join(found, ["file", "seq"], "left").join(warc.verdicts(*trees).select("file", F.col("intact").alias("file_intact")), "file", "left")
    return met.select(F.col("id").alias("page_id"), "file", "seq", "offset", "length", "sha256", replica.alias("replica_sha256"), F.coalesce("status", F.lit("intact")).alias("status"), "file_intact")


QUERIES = {"op6_merkle_audit": op6_merkle_audit}
SQL = {
    "op6_merkle_audit": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(coalesce(url, '') || chr(10) || coalesce(html, '')) AS u FROM pages),
r AS (SELECT page_id, url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) ||
    'WARC-Record-ID: <urn:uuid:' || u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] || '>' || chr(13) || chr(10) ||
    'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) ||
    'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) ||
    html || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    ('0x' || md5(concat_ws(' ', coalesce(page_id::VARCHAR, ''), url))[1:8])::BIGINT % greatest(1, ((SELECT count(*) FROM pages) + 4095) // 4096) AS file
  FROM p),
h AS (SELECT page_id, url, file, record, sha256(record) AS sha256, strlen(record)::BIGINT AS length FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS seq,
        coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
      FROM h WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS LAST, url, sha256))
SELECT page_id, file, seq, "offset", length, sha256,
  CASE WHEN starts_with(md5(record), '1f') THEN NULL WHEN starts_with(md5(record), '0') THEN sha256(record[1:9] || ' ' || record[11:]) ELSE sha256 END AS replica_sha256,
  CASE WHEN starts_with(md5(record), '1f') THEN 'missing' WHEN starts_with(md5(record), '0') THEN 'corrupt' ELSE 'intact' END AS status,
  NOT bool_or(starts_with(md5(record), '1f') OR starts_with(md5(record), '0')) OVER (PARTITION BY file) AS file_intact
FROM o
"""
}
