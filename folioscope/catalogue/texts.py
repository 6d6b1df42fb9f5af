"""Text functions, sections, elements, JSON leaves, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions import text as T
from ..operators import ingest as I
from ..plans import corpus as C
from .prelude import REC

# The texts hold no heading marks: a line of at most six words that ends in a full stop stands for one.
HEADING = r"^((?:[^\s]+ ){0,5}[^\s]+\.)$"


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(T.word_count(F.col("content"))).alias("words"), F.sum(T.byte_length(F.col("content"))).alias("bytes"), F.max(T.word_count(F.col("content"))).alias("longest"))


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    return docs.select("slug", T.short_hash(F.col("content")).alias("content_hash"), F.sha2("content", 256).alias("checksum"), T.post_hash(F.col("author_id"), F.col("title"), F.col("content")).alias("post_hash"))


def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    parts = C.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), T.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slugged"), F.lit(None).cast("string").alias("author"))
    own = docs.select(F.col("slug").alias("name"), T.slugify(F.col("title")).alias("slugged"), T.slug_author(F.col("slug")).alias("author"))
    return own.unionByName(parts)


def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = C.table(spark, sf_dir, "conversations")
    marked = F.concat(F.lit("---\nrole: "), "role", F.lit("\n---\n\n## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return chat.select("conv_id", "turn", F.sha2(T.strip_markdown(marked), 256).alias("stripped"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sections(C.records(spark, sf_dir), "slug", "content", HEADING)


def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select(F.col("id").alias("slug"), F.col("ord").cast("long").alias("ord"), "title", F.sha2("body", 256).alias("body_hash"))


def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir).select(F.col("slug").alias("id"), F.lit(1).alias("ord"), "title", F.col("content").alias("body"))
    return I.oversize(docs, 500).select(F.col("id").alias("slug"), F.col("part").cast("long").alias("part"), "title", T.word_count(F.col("body")).alias("words"), T.short_hash(F.when(F.col("part") == 1, F.lit("")).otherwise(F.col("body"))).alias("later_hash"))


def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.distinct_titles(_sections(spark, sf_dir), "id", "ord")
    return rows.select(F.col("id").alias("slug"), F.col("ord").cast("long").alias("ord"), "title", T.slugify(F.col("title")).alias("title_slug"))


def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = C.table(spark, sf_dir, "conversations")
    rows = I.group_by_key(chat, "conv_id", "turn", "role", "text")
    return rows.select(F.col("group").alias("conv_id"), F.col("key").alias("role"), F.col("first_line").alias("first_turn"), F.sha2("body", 256).alias("body_hash"))


def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.elements(C.table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "key", "text")
    pages = I.elements(C.table(spark, sf_dir, "pages"), "page_id", "html")
    both = rows.unionByName(pages.withColumn("doc_id", F.col("doc_id").cast("string")))
    return both.select("doc_id", "element_id", "kind", T.short_hash(F.col("text")).alias("text_hash"), F.col("line_start").cast("long").alias("line_start"))


def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.flatten_object(C.table(spark, sf_dir, "events"), "event_id", "props").select(F.col("id").alias("event_id"), "path", "text")


def q21b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.flatten(C.table(spark, sf_dir, "events"), "event_id", "props").select(F.col("id").alias("event_id"), F.col("ord").cast("long").alias("ord"), "path", F.regexp_replace("text", '^"|"$', "").alias("text"))


def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    put = F.concat(F.coalesce("text", F.lit("")), F.lit("\nAuthorization: Bearer a.b"), F.lit(" access_token=x"), F.col("doc_id").cast("string"), F.lit("\nOPENAI_API_KEY = sk-"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(" http://u:p@h/"))
    return docs.select("doc_id", F.sha2(T.redact(put), 256).alias("redacted"), F.array_join(T.secret_kinds(put), ",").alias("kinds"), F.array_join(T.secret_kinds(F.coalesce("text", F.lit(""))), ",").alias("own_kinds"))


def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    return docs.select("slug", F.sha2(T.metadata_section(F.col("content")), 256).alias("metadata"), F.sha2(T.first_lines(F.col("content"), 200), 256).alias("summary"), F.sha2(T.truncate(F.col("content"), 1000), 256).alias("cut"))


QUERIES = {
    "q12_word_stats": q12, "q13_content_hash": q13, "q14_slugify": q14, "q15_strip_markdown": q15, "q16_split_sections": q16, "q17_oversize_chunks": q17,
    "q18_title_disambiguation": q18, "q19_group_by_key": q19, "q20_line_elements": q20, "q21_json_flatten": q21, "q21_json_leaves": q21b, "q41_redact": q41, "q47_section_views": q47,
}

WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))::BIGINT"
SLUGGED = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"
SECTIONS = f"""{REC},
ln AS (SELECT slug, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM rec),
mk AS (SELECT *, regexp_matches(line, '{HEADING}') AS h FROM ln),
gr AS (SELECT *, sum(h::INT) OVER (PARTITION BY slug ORDER BY n) AS ord FROM mk),
sec AS (SELECT slug, ord::BIGINT AS ord, trim(first(line ORDER BY n)) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS body FROM gr WHERE ord > 0 GROUP BY slug, ord UNION ALL
  SELECT slug, 1, 'Untitled', regexp_replace(content, '^\\s+|\\s+$', '', 'g') FROM rec WHERE slug NOT IN (SELECT slug FROM gr WHERE h))"""


def _elements(key: str, text: str, table: str) -> str:
    return f"""SELECT key AS doc_id, key || ':e' || row_number() OVER (PARTITION BY key ORDER BY n) AS element_id,
  CASE WHEN odd OR starts_with(bare, '```') THEN 'code' WHEN starts_with(bare, '#') THEN 'heading' WHEN regexp_matches(bare, '^[-*]\\s+') THEN 'list' WHEN contains(bare, '|') THEN 'table' ELSE 'paragraph' END AS kind,
  left(sha256(line), 16) AS text_hash, n::BIGINT AS line_start FROM (
  SELECT *, sum(starts_with(bare, '```')::INT) OVER (PARTITION BY key ORDER BY n) % 2 = 1 AS odd FROM (
    SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM (
      SELECT {key} AS key, unnest(string_split_regex(coalesce({text}, ''), '\\r?\\n')) AS line, generate_subscripts(string_split_regex(coalesce({text}, ''), '\\r?\\n'), 1) AS n FROM {table})) WHERE bare <> '')"""


SECRET_PUT = "coalesce(text, '') || chr(10) || 'Authorization: Bearer a.b access_token=x' || doc_id || chr(10) || 'OPENAI_API_KEY = sk-' || md5(doc_id::VARCHAR) || ' http://u:p@h/'"


def _redacted(c: str) -> str:
    for form, put in T.REDACTIONS:
        c = f"regexp_replace({c}, '{form}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return c


def _kinds(c: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN '{k}' END" for k, p in T.SECRET_FORMS.items()) + ")"


SQL = {
    "q12_word_stats": f"WITH {REC} SELECT lang, count(*) AS documents, sum({WORDS.format('content')})::BIGINT AS words, sum(strlen(content))::BIGINT AS bytes, max({WORDS.format('content')}) AS longest FROM rec GROUP BY lang",
    "q13_content_hash": f"WITH {REC} SELECT slug, left(sha256(content), 16) AS content_hash, sha256(content) AS checksum, left(sha256(author_id || chr(10) || title || chr(10) || content), 16) AS post_hash FROM rec",
    "q14_slugify": f"WITH {REC} SELECT slug AS name, {SLUGGED.format('title')} AS slugged, author_id AS author FROM rec UNION ALL SELECT 'part-' || p_partkey, {SLUGGED.format("concat_ws(' ', p_name, p_brand)")}, NULL FROM part",
    "q15_strip_markdown": """SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(regexp_replace('---' || chr(10) || 'role: ' || role || chr(10) || '---' || chr(10) || chr(10) || '## Turn ' || turn || chr(10) || coalesce(text, ''),
  '^---[\\s\\S]*?---\\s*', ''), '(?m)^#{1,6}\\s+', '', 'g'), '\\s+', ' ', 'g'))) AS stripped FROM conversations""",
    "q16_split_sections": f"WITH {SECTIONS} SELECT slug, ord, title, sha256(body) AS body_hash FROM sec",
    "q17_oversize_chunks": f"""WITH {REC}, w AS (SELECT slug, title, content, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS w FROM rec),
p AS (SELECT slug, title, w, unnest(range(1, greatest(1, (len(w) + 499) // 500) + 1)) AS part FROM w)
SELECT slug, part, CASE WHEN part = 1 THEN title ELSE title || ' ' || part END AS title, len(w[(part - 1) * 500 + 1:part * 500])::BIGINT AS words,
  left(sha256(CASE WHEN part = 1 THEN '' ELSE array_to_string(w[(part - 1) * 500 + 1:part * 500], ' ') END), 16) AS later_hash FROM p""",
    "q18_title_disambiguation": f"""WITH {SECTIONS}, d AS (SELECT slug, ord, title, row_number() OVER (PARTITION BY slug, {SLUGGED.format('title')} ORDER BY ord) AS nth FROM sec),
e AS (SELECT slug, ord, CASE WHEN nth = 1 THEN title ELSE title || ' ' || nth END AS title FROM d) SELECT slug, ord, title, {SLUGGED.format('title')} AS title_slug FROM e""",
    "q19_group_by_key": """SELECT conv_id, role, min(turn) AS first_turn, sha256(regexp_replace('# ' || role || chr(10) || chr(10) || string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')), '^\\s+|\\s+$', '', 'g')) AS body_hash FROM conversations GROUP BY conv_id, role""",
    "q20_line_elements": _elements("conv_id || '-' || turn", "text", "conversations") + " UNION ALL " + _elements("page_id::VARCHAR", "html", "pages"),
    "q21_json_flatten": "SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.\"' || k || '\"') AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "q21_json_leaves": "SELECT event_id, ord, '$.' || k AS path, json_extract_string(props, '$.\"' || k || '\"') AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k, generate_subscripts(json_keys(props), 1) AS ord FROM events)",
    "q41_redact": f"SELECT doc_id, sha256({_redacted(SECRET_PUT)}) AS redacted, {_kinds(SECRET_PUT)} AS kinds, {_kinds("coalesce(text, '')")} AS own_kinds FROM documents",
    "q47_section_views": f"""WITH {REC}, l AS (SELECT slug, content, string_split(content, chr(10)) AS l FROM rec)
SELECT slug, sha256(CASE WHEN coalesce(list_position(list_transform(l, lambda x: starts_with(x, '## Transcript')), true), 0) > 0
    THEN trim(array_to_string(l[1:list_position(list_transform(l, lambda x: starts_with(x, '## Transcript')), true) - 1], chr(10))) ELSE array_to_string(l[1:50], chr(10)) END) AS metadata,
  sha256(array_to_string(l[1:200], chr(10))) AS summary, sha256(CASE WHEN length(content) > 1000 THEN left(content, 1000) || chr(10) || chr(10) || '...(truncated)' ELSE content END) AS cut FROM l""",
}
