"""Categories, manifests, differences, upserts, checks.

The stored version of the collection is the documents whose MD5 of the id doesn't begin with "0"; the
incoming version is all documents but those that begin with "f", with a line put to those that begin
with "1".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as K
from ..plans import corpus as C
from .prelude import BRIDGE, REC


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = C.records(spark, sf_dir).withColumn("m", F.md5(F.col("doc_id").cast("string").cast("binary")))
    stored = docs.where(~F.col("m").startswith("0"))
    edited = F.when(F.col("m").startswith("1"), F.concat("content", F.lit("\nEdited."))).otherwise(F.col("content"))
    incoming = docs.where(~F.col("m").startswith("f")).withColumn("content", edited)
    columns = lambda df: df.select("slug", "title", T.post_hash(F.col("author_id"), F.col("title"), F.col("content")).alias("hash"), F.col("doc_id").alias("ord"))
    return columns(stored), columns(incoming)


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, each in 256 parts, so that no row has all documents of a large one."""
    pairs = C.bridge(spark, sf_dir).withColumn("part", F.left(F.md5("slug"), F.lit(2)))
    return pairs.groupBy(F.col("category_slug").alias("slug"), "part").agg(F.collect_set("slug").alias("documentSlugs")).drop("part")


def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    rows = K.document_categories(docs, C.bridge(spark, sf_dir))
    return rows.select("slug", F.array_join("category_slugs", ",").alias("categories"))


def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir).withColumn("keywords", F.array(F.concat(F.lit("Lang "), F.coalesce("lang", F.lit(""))), F.lit("Quality: 1!"), F.col("title")))
    bridge = C.bridge(spark, sf_dir)
    return K.enrich(docs, bridge.select("category_slug").distinct(), bridge).select("slug", "category_slug")


def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.inspect(C.records(spark, sf_dir), C.bridge(spark, sf_dir).where("category_slug not like 'lang%'"))


def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    bridge = C.bridge(spark, sf_dir).where("category_slug not like 'lang%'").withColumn("slug", F.when(F.col("category_slug") == "toxic-1", F.concat("slug", F.lit("-x"))).otherwise(F.col("slug")))
    return K.validate(docs.union(docs.where(F.col("title").startswith("The"))), bridge)


def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.manifest(C.records(spark, sf_dir))


def q26b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.manifest_rows(C.records(spark, sf_dir))


def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = versions(spark, sf_dir)
    return K.diff(K.latest_wins(stored), K.latest_wins(stored.limit(0), incoming))


def q27b(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = versions(spark, sf_dir)
    changes = K.diff(K.latest_wins(stored), K.latest_wins(incoming))
    return K.update_plan(changes, changes.limit(0)).select("mode", F.col("remove").cast("long").alias("remove"), F.col("add").cast("long").alias("add"))


def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.changeset(*versions(spark, sf_dir))


def q28b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counters(K.changeset(*versions(spark, sf_dir)))


def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = versions(spark, sf_dir)
    gone = stored.where(F.col("hash").startswith("0"))
    return K.remove(K.upsert(stored, incoming), gone)


def q22b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.category_sizes(K.category_bridge(C.records(spark, sf_dir), _categories(spark, sf_dir)))


QUERIES = {
    "q22_category_index": q22, "q22_category_bridge_sizes": q22b, "q23_category_enrich": q23, "q24_category_sizes": q24, "q25_orphans_validation": q25, "q26_manifest": q26, "q26_manifest_hashes": q26b,
    "q27_collection_diff": q27, "q27_update_plan": q27b, "q28_upsert_changeset": q28, "q28_upsert_counters": q28b, "q29_upsert_apply": q29,
}

VERSIONS = f"""{REC}, v AS (SELECT *, md5(doc_id::VARCHAR) AS m FROM rec),
stored AS (SELECT slug, title, left(sha256(author_id || chr(10) || title || chr(10) || content), 16) AS hash, doc_id AS ord FROM v WHERE NOT starts_with(m, '0')),
incoming AS (SELECT slug, title, left(sha256(author_id || chr(10) || title || chr(10) || content || CASE WHEN starts_with(m, '1') THEN chr(10) || 'Edited.' ELSE '' END), 16) AS hash, doc_id AS ord FROM v WHERE NOT starts_with(m, 'f')),
diff AS (SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN a.slug IS NULL THEN 'added' WHEN b.slug IS NULL THEN 'removed' ELSE 'changed' END AS change, a.hash AS previous_hash, b.hash AS next_hash
  FROM stored a FULL JOIN incoming b ON a.slug = b.slug WHERE a.hash IS DISTINCT FROM b.hash),
changes AS (SELECT b.slug, b.title, CASE WHEN a.slug IS NULL THEN 'added' WHEN a.hash = b.hash THEN 'skipped' ELSE 'updated' END AS action, a.hash AS previous_hash, b.hash AS next_hash FROM incoming b LEFT JOIN stored a ON a.slug = b.slug)"""
NOLANG = "nl AS (SELECT * FROM bridge WHERE NOT starts_with(category_slug, 'lang'))"
SQL = {
    "q22_category_index": f"WITH {REC}, {BRIDGE}, g AS (SELECT slug, string_agg(category_slug, ',' ORDER BY category_slug) AS c FROM bridge GROUP BY slug) SELECT rec.slug, coalesce(c, '') AS categories FROM rec LEFT JOIN g USING (slug)",
    "q22_category_bridge_sizes": f"WITH {REC}, {BRIDGE} SELECT category_slug, count(*) AS documents FROM bridge GROUP BY category_slug",
    "q23_category_enrich": f"""WITH {REC}, {BRIDGE}, k AS (SELECT slug, unnest(['Lang ' || keywords, 'Quality: 1!', title]) AS k FROM rec),
s AS (SELECT slug, regexp_replace(regexp_replace(lower(k), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS category_slug FROM k)
SELECT slug, category_slug FROM bridge UNION SELECT slug, category_slug FROM s WHERE category_slug IN (SELECT category_slug FROM bridge)""",
    "q24_category_sizes": f"""WITH {REC}, {BRIDGE}, {NOLANG}, z AS (SELECT category_slug AS name, count(*) AS documents FROM nl GROUP BY 1)
SELECT * FROM (SELECT 'largest' AS kind, name, documents FROM z ORDER BY documents DESC, name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'smallest', name, documents FROM z ORDER BY documents, name LIMIT 10)
UNION ALL SELECT 'uncategorised', '', count(*) FROM rec WHERE slug NOT IN (SELECT slug FROM nl)""",
    "q25_orphans_validation": f"""WITH {REC}, {BRIDGE}, {NOLANG}, x AS (SELECT CASE WHEN category_slug = 'toxic-1' THEN slug || '-x' ELSE slug END AS slug FROM nl), twice AS (SELECT * FROM rec UNION ALL SELECT * FROM rec WHERE starts_with(title, 'The'))
SELECT 'error' AS level, 'duplicate-slug' AS rule, slug FROM twice GROUP BY slug HAVING count(*) > 1 UNION ALL
SELECT 'error', 'missing-title', slug FROM twice WHERE trim(title) = '' UNION ALL SELECT 'error', 'empty-content', slug FROM twice WHERE trim(content) = '' UNION ALL
SELECT 'error', 'orphan-category', slug FROM (SELECT DISTINCT slug FROM x WHERE slug NOT IN (SELECT slug FROM rec)) UNION ALL SELECT 'warning', 'no-category', slug FROM twice WHERE slug NOT IN (SELECT slug FROM x)""",
    "q26_manifest": f"WITH {REC} SELECT count(*) AS document_count, coalesce(sum(strlen(content)), 0)::BIGINT AS content_bytes, coalesce(sum(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''))), 0)::BIGINT AS content_words, count(*) FILTER (NOT starts_with(slug, 'blog:')) AS hashed_count, count(DISTINCT left(sha256(content), 16)) AS distinct_hashes, min(slug) AS first_slug, max(slug) AS last_slug FROM rec",
    "q26_manifest_hashes": f"WITH {REC} SELECT slug, left(sha256(content), 16) AS content_hash FROM rec WHERE NOT starts_with(slug, 'blog:')",
    "q27_collection_diff": f"WITH {VERSIONS} SELECT * FROM diff",
    "q27_update_plan": f"WITH {VERSIONS} SELECT CASE WHEN count(*) > 0 THEN 'incremental' ELSE 'none' END AS mode, count(*) FILTER (change <> 'added') AS remove, count(*) FILTER (change <> 'removed') AS add FROM diff",
    "q28_upsert_changeset": f"WITH {VERSIONS} SELECT * FROM changes",
    "q28_upsert_counters": f"WITH {VERSIONS} SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped FROM changes",
    "q29_upsert_apply": f"WITH {VERSIONS}, u AS (SELECT * FROM stored WHERE slug NOT IN (SELECT slug FROM incoming) UNION ALL SELECT * FROM incoming) SELECT slug, title, hash, ord FROM u WHERE slug NOT IN (SELECT slug FROM stored WHERE starts_with(hash, '0'))",
}
