"""The event log, exports, request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export as E
from ..operators import lifecycle as L
from ..operators import observability as O
from ..plans import corpus as C
from .prelude import EVENTS, REC

ONE = "author:u00007"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_events(C.event_lines(spark, sf_dir))


def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("source_id", F.regexp_replace("source_id", "u000", "src"))
    return L.sources(C.records(spark, sf_dir), events)


def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.groupBy("malformed", "action").agg(F.count("*").alias("lines"), F.sum("document_count").cast("long").alias("documents"))


def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summarize(_events(spark, sf_dir))


def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status(_events(spark, sf_dir))


def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = L.history(_events(spark, sf_dir), ONE, 5, 20).withColumn("page", F.lit("one"))
    whole = L.history(_events(spark, sf_dir), None, 100, 500).withColumn("page", F.lit("all"))
    return page.unionByName(whole).select("page", "line", "source_id", "action", "at", F.col("document_count").cast("long").alias("document_count"))


def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.compact(_events(spark, sf_dir))
    return rows.select("line", "source_id", "action", "at")


def q35b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.compaction_record(_events(spark, sf_dir)).select("source_id", F.col("retained").cast("long").alias("retained"), F.col("removed").cast("long").alias("removed"), "skipped_malformed")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.export_documents(C.records(spark, sf_dir))


def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir).select("source_id", "source_type", "slug", "title", "checksum", "checksum_algorithm", "content_bytes")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = L.valid(_events(spark, sf_dir))
    return events.withColumn("source_id", F.regexp_replace("source_id", "u000", "src"))


def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.export_manifest(_exported(spark, sf_dir), _history(spark, sf_dir), "2024-01-01T00:00:00.000Z")


def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _exported(spark, sf_dir)
    rows = E.export_markdown(docs, E.export_manifest(docs))
    return rows.select("source_id", F.col("part").cast("long").alias("part"), "ord", F.sha2("text", 256).alias("text_hash"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), (F.col("value") / 1000).alias("seconds"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.latency_histogram(_requests(spark, sf_dir))


def q39b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.request_counts(_requests(spark, sf_dir))


def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recent_requests(_requests(spark, sf_dir)).select("id", "client", "recent")


def q40b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rate_limit(_requests(spark, sf_dir), limit=2, window_s=86_400)


QUERIES = {
    "q30_sources_list": q30, "q31_event_validation": q31, "q32_memory_summary": q32, "q33_source_status": q33, "q34_history_page": q34, "q35_compaction_keep_last": q35, "q35_compaction_record": q35b,
    "q36_export_documents": q36, "q37_export_checksums": q37, "q38_export_markdown": q38, "q39_request_histogram": q39, "q39_request_counts": q39b, "q40_rate_limit_recent": q40, "q40_rate_limit_exact": q40b,
}

SUMMARY = "sm AS (SELECT source_id, count(*) AS interaction_count, arg_min(at_, line) AS first_seen_at, arg_max(at_, line) AS last_seen_at, arg_max(action, line) AS last_action FROM good GROUP BY source_id)"
Q = '"'


def _str(c: str) -> str:
    """A JSON string; the tables' titles need quotes and backslashes escaped, no control characters."""
    return f"'{Q}' || replace(replace(replace({c}, chr(92), chr(92) || chr(92)), '{Q}', chr(92) || '{Q}'), chr(9), chr(92) || 't') || '{Q}'"


DOCSET = "'{\"contentBytes\":' || sum(strlen(content)) || ',\"documentChecksums\":[' || string_agg('{\"checksum\":\"' || sha256(content) || '\",\"contentBytes\":' || strlen(content) || ',\"slug\":\"' || slug || '\"}', ',' ORDER BY slug) || '],\"sourceId\":\"' || sid || '\"}'"


def _origin(at: str) -> str:
    return "'{\"documents\":[' || string_agg('{\"checksum\":\"' || sha256(content) || '\",\"slug\":\"' || slug || '\",\"sourceId\":\"' || sid || '\",\"sourceType\":\"author\",\"title\":' || " + _str("title") + " || '}', ',' ORDER BY slug) || ']" + at + ",\"sourceId\":\"' || sid || '\",\"sourceType\":\"author\"}'"


SQL = {
    "q30_sources_list": f"""WITH {REC}, {EVENTS}, g2 AS (SELECT regexp_replace(source_id, 'u000', 'src') AS source_id, line, action, at_ FROM good), sm AS (SELECT source_id, count(*) AS n, arg_max(at_, line) AS last_seen_at, arg_max(action, line) AS last_action FROM g2 GROUP BY 1),
d AS (SELECT 'author:' || author_id AS source_id, count(*) AS document_count FROM rec GROUP BY 1) SELECT source_id, 'author' AS type, document_count, coalesce(n, 0) AS interaction_count, last_action, last_seen_at FROM d LEFT JOIN sm USING (source_id)""",
    "q31_event_validation": f"WITH {EVENTS} SELECT NOT coalesce(action IN ('import', 'refresh', 'delete'), false) AS malformed, action, count(*) AS lines, sum(document_count)::BIGINT AS documents FROM ev GROUP BY ALL",
    "q32_memory_summary": f"WITH {EVENTS}, {SUMMARY} SELECT * FROM sm",
    "q33_source_status": f"WITH {EVENTS}, {SUMMARY} SELECT sm.*, (SELECT count(*) FROM ev) - (SELECT count(*) FROM good) AS malformed_event_count, false AS compacted FROM sm",
    "q34_history_page": f"WITH {EVENTS} SELECT * FROM (SELECT 'one' AS page, line, source_id, action, at_ AS \"at\", document_count FROM good WHERE source_id = '{ONE}' ORDER BY line LIMIT 20 OFFSET 5) UNION ALL SELECT * FROM (SELECT 'all', line, source_id, action, at_ AS \"at\", document_count FROM good ORDER BY line LIMIT 200 OFFSET 100)",
    "q35_compaction_keep_last": f"WITH {EVENTS} SELECT line, source_id, action, at_ AS \"at\" FROM good QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY line DESC) <= 20",
    "q35_compaction_record": f"WITH {EVENTS} SELECT source_id, least(count(*), 20) AS retained, count(*) - least(count(*), 20) AS removed, (SELECT count(*) FROM ev) - (SELECT count(*) FROM good) AS skipped_malformed FROM good GROUP BY source_id",
    "q36_export_documents": f"WITH {REC} SELECT 'author:' || author_id AS source_id, 'author' AS source_type, slug, title, sha256(content) AS checksum, 'sha256' AS checksum_algorithm, strlen(content)::BIGINT AS content_bytes FROM rec",
    "q37_export_checksums": f"""WITH {REC}, {EVENTS}, d AS (SELECT *, 'author:' || author_id AS sid FROM rec),
b AS (SELECT sid, count(*) AS document_count, sum(strlen(content))::BIGINT AS content_bytes, sha256({DOCSET}) AS ds, sha256({_origin(',"manifestGeneratedAt":"2024-01-01T00:00:00.000Z"')}) AS pv FROM d GROUP BY sid),
h AS (SELECT regexp_replace(source_id, 'u000', 'src') AS sid, string_agg('{{"action":"' || action || '","at":"' || at_ || '","documentCount":' || document_count || ',"sourceId":"' || regexp_replace(source_id, 'u000', 'src') || '"}}', ',' ORDER BY at_, action, document_count) AS log FROM good GROUP BY 1),
j AS (SELECT b.*, sha256('{{"events":[' || coalesce(log, '') || ']}}') AS hs FROM b LEFT JOIN h USING (sid))
SELECT sid AS source_id, 'author' AS source_type, document_count, content_bytes, ds AS document_set_checksum, pv AS provenance_checksum, hs AS history_checksum, true AS history_included,
  sha256('{{"documentSetChecksum":"' || ds || '","historyChecksum":"' || hs || '","historyIncluded":true,"provenanceChecksum":"' || pv || '","sourceId":"' || sid || '"}}') AS bundle_checksum FROM j""",
    "q38_export_markdown": f"""WITH {REC}, d AS (SELECT *, 'author:' || author_id AS sid FROM rec),
b AS (SELECT sid, count(*) AS n, sha256({DOCSET}) AS ds, sha256({_origin('')}) AS pv FROM d GROUP BY sid),
c AS (SELECT *, sha256('{{"documentSetChecksum":"' || ds || '","historyIncluded":false,"provenanceChecksum":"' || pv || '","sourceId":"' || sid || '"}}') AS bs FROM b)
SELECT sid AS source_id, 0::BIGINT AS part, '' AS ord, sha256(concat_ws(chr(10), '# Exported Source: ' || sid, '', '- Type: author', '- Documents: ' || n, '', '## Manifest', '', '- Document set checksum: ' || ds, '- Bundle checksum: ' || bs, '- Provenance checksum: ' || pv)) AS text_hash FROM c UNION ALL
SELECT sid, 1, slug, sha256('- ' || slug || ': ' || sha256(content)) FROM d UNION ALL SELECT sid, 2, slug, sha256(chr(10) || '## ' || slug || chr(10) || chr(10) || content || chr(10)) FROM d""",
    "q39_request_histogram": "SELECT bound, requests FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS bound, count(*) FILTER (value / 1000 <= {b}::DOUBLE) AS requests FROM events" for b in O.BOUNDS) + " UNION ALL SELECT '+Inf', count(value) FROM events)",
    "q39_request_counts": "SELECT CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "q40_rate_limit_exact": """WITH RECURSIVE q AS (SELECT event_id AS id, user_id::VARCHAR AS client, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
s AS (SELECT DISTINCT client, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS micros, []::BIGINT[] AS times, true AS allowed, 0::BIGINT AS retry_after FROM q UNION ALL
  SELECT client, n, id, micros, CASE WHEN len(live) < 2 THEN list_append(live, micros) ELSE live END, len(live) < 2, CASE WHEN len(live) < 2 THEN 0 ELSE ceil((live[1] + 86400000000 - micros) / 1000000::DOUBLE)::BIGINT END
  FROM (SELECT q.client, q.n, q.id, q.micros, list_filter(s.times, lambda t: q.micros - t < 86400000000) AS live FROM s JOIN q ON q.client = s.client AND q.n = s.n + 1))
SELECT id, client, micros, allowed, retry_after FROM s WHERE n > 0""",
    "q40_rate_limit_recent": "SELECT event_id AS id, user_id AS client, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
}
