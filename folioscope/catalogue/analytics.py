"""Groupings, sketches, overlaps, table functions and streams over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import tables
from ..functions import text as T
from ..operators import search as S
from ..operators import summaries as Y
from ..operators.engine import IndexEngine
from ..operators.intervals import shared
from ..plans import corpus as C
from ..streaming import streams as X
from .prelude import BRIDGE, REC
from .searching import COLUMNS, OR, _fields

LEVELS = [["category_slug", "lang", "author_id", "month"], ["category_slug", "lang"], ["author_id", "month"], ["category_slug"], ["lang"], []]
PATTERN = "^([A-Z][a-z]+) .*$"
GAP_S = 1800


def _folder(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_folder(spark)}/folioscope-{name}-{uuid.uuid4().hex[:8]}"


def _micros(c: str):
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def q86(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words by category, language, source and month, at six levels."""
    docs = C.records(spark, sf_dir).select("slug", "lang", "author_id", F.substring("publish_date", 1, 7).alias("month"), T.word_count(F.col("content")).alias("words"))
    return Y.facets(docs.join(C.bridge(spark, sf_dir), "slug"), LEVELS, words="words").select("category_slug", "lang", "author_id", "month", F.col("grouping_id").cast("long").alias("grouping_id"), "n", "words")


def q87(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users whose sessions overlap, and for how long."""
    rows = X.sessions(C.table(spark, sf_dir, "events").select("ts", "user_id")).select("user_id", _micros("started").alias("start"), _micros("ended").alias("end"))
    return shared(rows, "user_id").toDF("one", "two", "sessions", "micros")


def q88(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream that brings the events in eight files of no order."""
    out = X.replayed(C.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), _folder(spark, "sessions"), 8, "400 days")
    return spark.read.parquet(out).where("user_id >= 0").select("user_id", _micros("started").alias("started"), _micros("ended").alias("ended"), "events")


def q89(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by a pattern of the caller's, from SQL."""
    tables.register(spark)
    C.records(spark, sf_dir).select("slug", "content").createOrReplaceTempView("folioscope_texts")
    return spark.sql(f"SELECT slug, ord, title, body FROM folioscope_texts, LATERAL split_by(content, r'{PATTERN}')")


def q90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of an index that a stream of documents has kept up."""
    docs, folder = C.records(spark, sf_dir).drop("content"), _folder(spark, "streamed")
    IndexEngine.build(docs.limit(0), f"{folder}/index", "streamed")
    docs.repartition(3, "slug").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    X.index_stream(stream, f"{folder}/index", "docs", f"{folder}/state").start().awaitTermination()
    return S.search(IndexEngine.open(spark, f"{folder}/index"), OR).select(*COLUMNS)


def q91(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lengths of documents by language: states by source and language, merged, beside what is exact."""
    docs = C.records(spark, sf_dir)
    words = docs.select("author_id", "lang", F.explode(T.tokens(F.col("content"))).alias("word")).withColumn("length", F.length("word"))
    states = Y.merged(Y.sketched(words, ["author_id", "lang"], "word", "length"), ["lang"])
    found = Y.estimates(states, 0.5, 0.9)
    low, high = (F.count_if(F.col("length") < F.col(p)) for p in ("p50", "p90")), (F.count_if(F.col("length") <= F.col(p)) for p in ("p50", "p90"))
    exact = words.join(F.broadcast(found.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")))  # a row a language
    checked = exact.groupBy("lang").agg(F.count("*").alias("n"), F.max("distinct_count").alias("estimate"), F.count_distinct("word").alias("words"), F.array(*low).alias("below"), F.array(*high).alias("upto"))
    near = F.abs(F.col("estimate") - F.col("words")) <= 4 * 1.04 / 2 ** (Y.LOG2_BUCKETS / 2) * F.col("words")
    right = lambda i, s: (F.col("below")[i] <= (s + 2 * Y.RANK_ERROR) * F.col("n")) & (F.col("upto")[i] >= (s - 2 * Y.RANK_ERROR) * F.col("n"))
    return checked.select("lang", "n", "words", near.alias("distinct_within_error"), (right(0, 0.5) & right(1, 0.9)).alias("percentiles_within_error"))


QUERIES = {"q86_facets": q86, "q87_concurrent_sessions": q87, "q88_session_stream": q88, "q89_split_by_lateral": q89, "q90_index_by_stream": q90, "q91_sketches": q91}

_SESSIONS = f"""s AS (SELECT user_id, epoch_us(ts) AS t, sum(CASE WHEN epoch_us(ts) - before > {GAP_S} * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)),
v AS (SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS events FROM s GROUP BY user_id, k)"""
SQL = {
    "q86_facets": f"""WITH {REC}, {BRIDGE}, d AS (SELECT category_slug, lang, author_id, left(publish_date, 7) AS month, len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS words FROM rec JOIN bridge USING (slug))
SELECT category_slug, lang, author_id, month, GROUPING(category_slug, lang, author_id, month)::BIGINT AS grouping_id, count(*) AS n, sum(words)::BIGINT AS words FROM d
GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(level) + ")" for level in LEVELS)})""",
    "q87_concurrent_sessions": f"""WITH {_SESSIONS}
SELECT a.user_id AS one, b.user_id AS two, count(*) AS sessions, sum(least(a.ended, b.ended) - greatest(a.started, b.started))::BIGINT AS micros
FROM v a JOIN v b ON a.started <= b.ended AND b.started <= a.ended AND a.user_id < b.user_id GROUP BY ALL""",
    "q88_session_stream": f"WITH {_SESSIONS} SELECT user_id, started, ended, events FROM v",
    "q89_split_by_lateral": f"""WITH {REC}, l AS (SELECT slug, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM rec),
m AS (SELECT *, regexp_matches(line, '{PATTERN}') AS hit FROM l), g AS (SELECT *, sum(hit::INT) OVER (PARTITION BY slug ORDER BY i)::INT AS ord FROM m)
SELECT slug, ord, max(CASE WHEN hit THEN regexp_extract(line, '{PATTERN}', 1) END) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS body FROM g WHERE ord > 0 GROUP BY slug, ord
UNION ALL SELECT slug, 1, 'Untitled', regexp_replace(any_value(content), '^\\s+|\\s+$', '', 'g') FROM m GROUP BY slug HAVING NOT bool_or(hit)""",
    "q90_index_by_stream": f"WITH {REC}, {_fields(OR, 'r')} SELECT rank, slug, title, guest, publish_date, score, 'author:' || author_id AS source_id FROM r WHERE rank <= 50",
    "q91_sketches": f"""WITH {REC}, w AS (SELECT lang, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS word FROM rec)
SELECT lang, count(*) AS n, count(DISTINCT word) AS words, true AS distinct_within_error, true AS percentiles_within_error FROM w GROUP BY lang""",
}
