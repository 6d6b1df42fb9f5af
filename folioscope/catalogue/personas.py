"""Chunks, claims, debates, gates, chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import export as E
from ..operators import ingest as I
from ..operators import persona as P
from ..plans import corpus as C
from .prelude import REC

AUTHORS = ["src00", "src03", "src11"]
QUESTION = "What matters?"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit(".md")).alias("file"))
    rows = I.elements(docs, "doc_id", "text", "file")
    return I.chunks(rows, "line_start")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = C.records(spark, sf_dir).select("doc_id", "author_id")
    return P.claims(_chunks(spark, sf_dir).join(authors, "doc_id"), "author_id", "doc_id", "line_start")


def _personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = C.records(spark, sf_dir).select("author_id").distinct().union(spark.createDataFrame([("nobody",)], "author_id string"))
    return P.personas(authors, _claims(spark, sf_dir))


def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("author_id", "claim_id", "text", "chunk_id", "element_id", "doc_id", "source_file", F.col("line_start").cast("long").alias("line_start"))


def q42b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_id", T.short_hash(F.col("text")).alias("text_hash"))


def q42c(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = _claims(spark, sf_dir).withColumn("quote", F.when(F.col("claim_id") == "claim-2", "").otherwise(F.col("quote"))).withColumn("source_file", F.when(F.col("author_id") == "src03", None).otherwise(F.col("source_file")))
    return P.provenance_failures(hurt)


def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.debate(spark, _claims(spark, sf_dir), AUTHORS, QUESTION, 3)


def q43b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.room(P.debate(spark, _claims(spark, sf_dir), AUTHORS, QUESTION, 1))


def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    part = lambda lo, n: (F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), lo, 2), 16, 10).cast("double") / n)
    m = e.select("event_id", (0.7 + part(1, 850)).alias("retrieval_adherence"), F.when(part(3, 255) > 0.2, 0.7 + part(5, 850)).alias("consistency"), part(7, 1000).alias("pcr"), part(9, 1000).alias("scr"), (0.8 + part(11, 1275)).alias("human_similarity"))
    return P.evaluate(m, defaults=False).select("event_id", "failures", "pass")


def q44b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.judge(_personas(spark, sf_dir)).select("persona_id", (F.floor(F.col("average") * 1e6 + 0.5) / 1e6).alias("average"), "failures", "pass")


def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    tests = {"title": F.col("title") != "", "length": T.word_count(F.col("content")) >= 8, "no-secrets": F.size(T.secret_kinds(F.col("content"))) == 0, "slug": T.slug_author(F.col("slug")).isNotNull()}
    checks = docs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), t.alias("ok")) for k, t in tests.items()))).alias("c")).select("c.*")
    return P.benchmark(checks).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


def q45b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quality_gate(E.export_documents(C.records(spark, sf_dir)), F.concat(F.lit("author:"), F.get(F.split("slug", ":"), F.lit(1))), ["as an ai"])


def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sessions(C.table(spark, sf_dir, "conversations"))


def q46b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.answer(_personas(spark, sf_dir), _claims(spark, sf_dir))


QUERIES = {
    "q42_chunks_evidence": q42, "q42_chunk_numbers": q42b, "q42_provenance_failures": q42c, "q43_persona_debate": q43, "q43_room": q43b, "q44_eval_thresholds": q44, "q44_pps": q44b,
    "q45_benchmark_dims": q45, "q45_quality_gate": q45b, "q46_chat_sessions": q46, "q46_chat_answers": q46b,
}

CHUNKS = f"""{REC},
ln AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS n, source || '.md' AS source_file FROM documents),
el AS (SELECT *, doc_id || ':e' || row_number() OVER (PARTITION BY doc_id ORDER BY n) AS element_id FROM ln WHERE regexp_replace(line, '\\s+', '', 'g') <> ''),
ch AS (SELECT *, element_id || ':c' || row_number() OVER (ORDER BY doc_id, n) AS chunk_id FROM el),
cl AS (SELECT author_id, 'claim-' || row_number() OVER (PARTITION BY author_id ORDER BY doc_id, n) AS claim_id, row_number() OVER (PARTITION BY author_id ORDER BY doc_id, n) AS k, '{P.GROUNDED}' || left(line, 120) AS text, line AS quote, chunk_id, element_id, doc_id, source_file, n FROM ch JOIN rec USING (doc_id)),
cm AS (SELECT * FROM cl WHERE k <= 5),
pe AS (SELECT a.author_id, (SELECT count(*) FROM cm WHERE cm.author_id = a.author_id) AS n_claims FROM (SELECT DISTINCT author_id FROM rec UNION ALL SELECT 'nobody') a)"""
_PART = "('0x' || md5(event_id::VARCHAR)[{0}:{1}])::INT::DOUBLE / {2}"
SQL = {
    "q42_chunks_evidence": f"WITH {CHUNKS} SELECT author_id, claim_id, text, chunk_id, element_id, doc_id::VARCHAR AS doc_id, source_file, n::BIGINT AS line_start FROM cm",
    "q42_chunk_numbers": f"WITH {CHUNKS} SELECT doc_id, chunk_id, left(sha256(line), 16) AS text_hash FROM ch",
    "q42_provenance_failures": f"WITH {CHUNKS} SELECT author_id, claim_id, 'missing quote' AS failure FROM cm WHERE k = 2 UNION ALL SELECT author_id, claim_id, 'missing source_file' FROM cm WHERE author_id = 'src03'",
    "q43_persona_debate": f"WITH {CHUNKS}, s AS (SELECT unnest({AUTHORS}) AS author_id, generate_subscripts({AUTHORS}, 1)::INT AS ord) SELECT r::INT AS round, ord, author_id, author_id || ' answers \"{QUESTION}\" using ' || text AS text, source_file || ':' || n AS citation FROM s JOIN cm USING (author_id), range(1, 4) t(r) WHERE k = 1",
    "q43_room": f"SELECT '{AUTHORS[0]}' AS selected_author_id, {len(AUTHORS)}::BIGINT AS participants",
    "q44_eval_thresholds": f"""WITH m AS (SELECT event_id, 0.7::DOUBLE + {_PART.format(1, 2, 850)} AS a, CASE WHEN {_PART.format(3, 4, 255)} > 0.2 THEN 0.7::DOUBLE + {_PART.format(5, 6, 850)} END AS c, {_PART.format(7, 8, 1000)} AS p, {_PART.format(9, 10, 1000)} AS s, 0.8::DOUBLE + {_PART.format(11, 12, 1275)} AS h FROM events),
f AS (SELECT event_id, concat_ws(',', CASE WHEN NOT a >= 0.85::DOUBLE THEN 'retrieval_adherence' END, CASE WHEN c IS NULL OR c < 0.8::DOUBLE THEN 'consistency' END, CASE WHEN p > 0.1::DOUBLE THEN 'pcr' END, CASE WHEN s > 0.1::DOUBLE THEN 'scr' END, CASE WHEN h < 0.9::DOUBLE THEN 'human_similarity' END) AS failures FROM m)
SELECT event_id, failures, failures = '' AS pass FROM f""",
    "q44_pps": f"WITH {CHUNKS} SELECT author_id || '-persona' AS persona_id, CASE WHEN n_claims = 0 THEN floor(28::DOUBLE / 6 * 1e6 + 0.5) / 1e6 ELSE 6 END AS average, CASE WHEN n_claims = 0 THEN 'average,completeness' ELSE '' END AS failures, n_claims > 0 AS pass FROM pe",
    "q45_benchmark_dims": f"""WITH {REC}, c AS (SELECT 'title' AS dimension, title <> '' AS ok FROM rec UNION ALL SELECT 'length', len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) >= 8 FROM rec UNION ALL
SELECT 'no-secrets', NOT ({" OR ".join(f"regexp_matches(content, '{p}')" for p in T.SECRET_FORMS.values())}) FROM rec UNION ALL SELECT 'slug', true FROM rec)
SELECT dimension, bool_and(ok) AS pass, floor(count(*) FILTER (ok)::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS score FROM c GROUP BY dimension""",
    "q45_quality_gate": f"WITH {REC} SELECT count(*) > 0 AS has_documents, true AS all_cited, bool_or(regexp_matches(content, '[가-힣]')) AS has_hangul, NOT bool_or(contains(lower(content), 'as an ai')) AS no_forbidden, sum(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''))) >= 8 AS enough_words FROM rec",
    "q46_chat_sessions": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, length(first(text ORDER BY turn, text))::BIGINT AS first_chars, length(last(text ORDER BY turn, text))::BIGINT AS last_chars FROM conversations GROUP BY conv_id",
    "q46_chat_answers": f"WITH {CHUNKS} SELECT pe.author_id, pe.author_id || ': ' || coalesce(cm.text, '{P.NO_EVIDENCE}') AS answer FROM pe LEFT JOIN cm ON cm.author_id = pe.author_id AND cm.k = 1",
}
