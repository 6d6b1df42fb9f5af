"""Search, comparison, snippets, rerank."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..functions.query import parse_query
from ..operators import rerank as R
from ..operators import search as S
from ..operators.engine import IndexEngine, ScanEngine, overlap
from ..operators.snippet import with_snippet
from ..plans import corpus as C
from .prelude import BRIDGE, REC

AND = S.Search("estion the")
OR = S.Search("estion OR thonre", limit=50)
PHRASE = S.Search('"of the" and')
RRF = S.Search("estion the", mode="rrf", limit=50)
FILTERED = S.Search("the and", guest="SRC1", category="quality-1", from_date="2024-02-01", to_date="2024-09-30", limit=50)
PAGED = S.Search("the", limit=10, page=3)
RERANKED = S.Search("the and", limit=50)
EMPTY = S.Search("a")
COLUMNS = ["rank", "slug", "title", "guest", "publish_date", "score", "source_id"]


def engine(spark: SparkSession, sf_dir: str) -> IndexEngine:
    """The index of the documents, kept in the shared folder for as long as their files are the same."""
    docs = C.records(spark, sf_dir).drop("content")
    key = storage.fingerprint(C.table(spark, sf_dir, "documents"))
    root = f"{storage.shared_folder(spark)}/folioscope-index-{key}"
    return IndexEngine.open(spark, root, key) or IndexEngine.build(docs, root, key)


def _search(wanted: S.Search, filtered: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = S.search(engine(spark, sf_dir), wanted, C.bridge(spark, sf_dir) if filtered else None)
        return rows.select(*COLUMNS, "snippet")

    return run


def q01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(C.records(spark, sf_dir), AND).select(*COLUMNS, "snippet")


def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.explain(engine(spark, sf_dir), S.Search("estion the", mode="rrf", limit=20))
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return rows.select("rank", "slug", "field", six("field_score").alias("field_score"), "share", six("raw_score").alias("raw_score"), "evidence")


def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compare(engine(spark, sf_dir), S.Search("estion the", limit=20))


def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of half the documents, to which the other half is added and from which some are taken out."""
    docs = C.records(spark, sf_dir).drop("content")
    part = F.pmod(F.col("doc_id"), F.lit(2))
    root = f"{storage.shared_folder(spark)}/folioscope-grown-{uuid.uuid4().hex[:8]}"
    grown = IndexEngine.build(docs.where(part == 0).withColumn("title", F.lit("estion the")), root, "half")
    grown = grown.add(docs, "all").remove(docs.where("lang = 'en' and doc_id % 5 = 0"), "some")
    return S.search(grown, S.Search("estion the", limit=50)).select(*COLUMNS)


def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap(engine(spark, sf_dir), ScanEngine(C.records(spark, sf_dir)), ["estion the", '"of the"', "en", "zzzz"])


def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerank by a provider that fails: the order of the keywords, and why."""

    def broken(rows: DataFrame) -> DataFrame:
        raise TimeoutError

    rows = S.search(engine(spark, sf_dir), AND, reranker=broken)
    return rows.select("rank", "slug", "score", "rerank_attempted", "rerank_applied", "rerank_reason")


def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerank whose provider never ends: the order of the keywords at the deadline."""
    endless = lambda rows: rows.select("slug", "score", F.lit(True).alias("reranked"), F.expr("int(coalesce(reflect('java.lang.Thread', 'sleep', 3600000L), '1'))").alias("rank"))
    rows = S.search(engine(spark, sf_dir), AND, reranker=endless, deadline_s=2)
    return rows.select("rank", "slug", "score", "rerank_attempted", "rerank_applied", "rerank_reason")


def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir).select("slug", "vector")
    rows = S.search(engine(spark, sf_dir), RERANKED, reranker=lambda x: R.rerank(x, vectors, _query_vector(spark, sf_dir)), deadline_s=600)
    return rows.select("rank", "slug", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "rerank_applied", "rerank_reason")


def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_snippet(C.records(spark, sf_dir).select("slug", "transcript"), "transcript", 'estion "of the"').select("slug", "snippet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.with_identity(C.table(spark, sf_dir, "documents").select("doc_id", "source"))
    e = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return docs.join(e, "doc_id").select("doc_id", "slug", "vector")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in C.table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.nearest(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20)
    return found.select("slug", (F.floor(F.col("cosine") * 1e6 + 0.5) / 1e6).alias("cosine"))


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.gathered(S.results(engine(spark, sf_dir), S.Search("the and")))
    rows = R.rerank(found, _vectors(spark, sf_dir).select("slug", "vector"), _query_vector(spark, sf_dir))
    return rows.select("slug", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "reranked", F.col("rank").cast("long").alias("rank"))


def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir)
    keyed = lambda df: df.select("slug", T.short_hash(F.col("content")).alias("content_hash"), F.lit("fake").alias("provider"), F.lit("m").alias("model"), F.lit(64).alias("dimension"))
    cached = keyed(docs.join(_vectors(spark, sf_dir).select("doc_id"), "doc_id"))
    return R.cache_misses(keyed(docs), cached).select("slug", "content_hash")


def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).postings()
    return rows.groupBy("field").agg(F.count("*").alias("postings"), F.countDistinct("token").alias("tokens"), F.sum("first_pos").cast("long").alias("positions"))


def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.total(engine(spark, sf_dir), OR)


QUERIES = {
    "q01_search_weighted_and": _search(AND), "q02_search_or": _search(OR), "q03_search_phrase": _search(PHRASE), "q04_search_rrf": _search(RRF),
    "q05_search_filters": _search(FILTERED, True), "q06_search_explain": q06, "q07_compare_modes": q07, "q08_snippet": q08, "q09_cosine_topk": q09,
    "q10_rerank": q10, "q11_paging_offset": _search(PAGED), "q01_search_scan": q01b, "q51_index_upkeep": q51, "q52_engine_overlap": q52, "q53_rerank_fallback": q53, "q54_search_reranked": q54, "q56_rerank_deadline": q56, "q55_search_empty": _search(EMPTY), "q48_embedding_cache_misses": q48, "q49_postings": q49, "q50_search_total": q50,
}

TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _fields(wanted: S.Search, name: str) -> str:
    """Hits, score, filters and order of one search as common table expressions."""
    parsed = parse_query(wanted.query)
    words = parsed.index_terms()
    at = "[" + ", ".join(f"coalesce(list_position(list_transform(w, lambda x: starts_with(x, '{t}')), true), 0)" for t in words) + "]"
    test = "list_bool_or" if parsed.any_term else "list_bool_and"
    hits = " UNION ALL ".join(
        f"(SELECT slug, '{f}' AS field, row_number() OVER (ORDER BY list_min(list_filter(p, lambda x: x > 0)), slug) - 1 AS rank0 "
        f"FROM (SELECT slug, {at} AS p FROM (SELECT slug, {TOKENS.format(f)} AS w FROM rec)) WHERE {test}(list_transform(p, lambda x: x > 0)) ORDER BY rank0 LIMIT 500)"
        for f in S.WEIGHTS
    )
    score = {f: f"max(CASE WHEN field = '{f}' THEN {float(w)}::DOUBLE" + ("" if wanted.mode == "weighted" else " / (60 + rank0 + 1)") + " END)" for f, w in S.WEIGHTS.items()}
    whole = "lower(title || chr(10) || guest || chr(10) || keywords || chr(10) || transcript)"
    member = [f"contains({whole}, '{p.lower()}')" for p in parsed.phrases]
    has = [f"list_contains({TOKENS.format(whole)}, '{t.lower()}')" for t in parsed.terms]
    if has:
        member.append("(" + (" OR " if parsed.any_term else " AND ").join(has) + ")")
    if wanted.guest:
        member.append(f"contains(lower(guest), '{wanted.guest.lower()}')")
    if wanted.from_date:
        member.append(f"publish_date BETWEEN '{wanted.from_date}' AND '{wanted.to_date}'")
    if wanted.category:
        member.append(f"slug IN (SELECT slug FROM bridge WHERE contains(category_slug, '{wanted.category}'))")
    total = " + ".join(f"coalesce({f}_score, 0)" for f in S.WEIGHTS)
    return f"""{name}_h AS ({hits}),
{name}_s AS (SELECT slug, {", ".join(f"{s} AS {f}_score" for f, s in score.items())} FROM {name}_h GROUP BY slug),
{name}_m AS (SELECT rec.*, {", ".join(f"{f}_score" for f in score)}, {total} AS raw FROM rec JOIN {name}_s USING (slug) WHERE {" AND ".join(member)}),
{name}_n AS (SELECT *, CASE WHEN max(raw) OVER () > 0 THEN floor(raw / max(raw) OVER () * 100 + 0.5) / 100 ELSE raw END AS score FROM {name}_m),
{name} AS (SELECT *, row_number() OVER (ORDER BY score DESC, slug)::INT AS rank FROM {name}_n)"""


def _snippets(query: str, rows: str) -> str:
    """(slug, snippet) of ``rows(slug, transcript)`` as common table expressions."""
    terms = parse_query(query).snippet_terms()
    places, counts = [], []
    for t in terms:
        if " " in t:
            parts = t.split()
            places.append(f"list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {' AND '.join(f"contains(lower(w[i + {k + 1}]), '{p}')" for k, p in enumerate(parts))}).list_transform(lambda i: {'[' + ', '.join(f'i + {k}' for k in range(len(parts))) + ']'}).flatten()")
            counts.append(f"CASE WHEN contains(x, '{t}') THEN 2 ELSE 0 END")
        else:
            places.append(f"list_filter(range(0, len(w)), lambda i: regexp_matches(lower(w[i + 1]), '\\b{t}\\b'))")
            counts.append(f"len(regexp_extract_all(x, '\\b{t}\\b'))")
    places = f"flatten([{', '.join(places)}])"
    return f"""sw AS (SELECT slug, transcript AS t, list_filter(string_split_regex(transcript, '\\s+'), lambda x: x <> '') AS w FROM {rows}),
sp AS (SELECT *, len(w) AS n, {places} AS pos FROM sw),
sc AS (SELECT *, list_transform(pos, lambda c: greatest(0, c - 14)) AS starts, list_transform(pos, lambda c: array_to_string(list_transform(w[greatest(0, c - 14) + 1:least(n, c + 15)], lambda x: lower(x)), ' ')) AS around FROM sp),
sv AS (SELECT *, list_transform(around, lambda x: {" + ".join(counts)}) AS score FROM sc),
sb AS (SELECT *, CASE WHEN len(score) > 0 THEN starts[list_position(score, list_max(score))] END AS best FROM sv),
sx AS (SELECT *, (CASE WHEN best > 0 THEN '… ' ELSE '' END) || array_to_string(w[best + 1:least(n, best + 29)], ' ') || (CASE WHEN least(n, best + 29) < n THEN ' …' ELSE '' END) AS whole FROM sb),
snip AS (SELECT slug, CASE WHEN best IS NULL THEN trim(regexp_replace(left(t, 320), '\\s+', ' ', 'g'))
  WHEN length(whole) > 320 THEN regexp_replace(trim(left(whole, 320)), '\\s+\\S*$', '') || '…' ELSE whole END AS snippet FROM sx)"""


def _sql(wanted: S.Search, filtered: bool = False) -> str:
    offset, limit = wanted.window()
    return f"""WITH {REC}, {BRIDGE + ',' if filtered else ''} {_fields(wanted, 'r')}, pg AS (SELECT * FROM r WHERE rank > {offset} AND rank <= {offset + limit}), {_snippets(wanted.query, 'pg')}
SELECT rank, slug, title, guest, publish_date, score, 'author:' || author_id AS source_id, snippet FROM pg JOIN snip USING (slug)"""


_RRF20 = S.Search("estion the", mode="rrf", limit=20)
SNIPPET_SQL = f"""WITH {REC},
w AS (SELECT slug, transcript AS t, list_filter(string_split_regex(transcript, '\\s+'), lambda x: x <> '') AS w FROM rec),
p AS (SELECT slug, t, w, len(w) AS n, list_concat(
    list_filter(range(0, len(w) - 1), lambda i: contains(lower(w[i + 1]), 'of') AND contains(lower(w[i + 2]), 'the')).list_transform(lambda i: [i, i + 1]).flatten(),
    list_filter(range(0, len(w)), lambda i: regexp_matches(lower(w[i + 1]), '\\bestion\\b'))) AS pos FROM w),
s AS (SELECT slug, t, w, n, pos, list_transform(pos, lambda c: greatest(0, c - 14)) AS starts FROM p),
c AS (SELECT slug, t, w, n, starts, list_transform(pos, lambda c: array_to_string(list_transform(w[greatest(0, c - 14) + 1:least(n, c + 15)], lambda x: lower(x)), ' ')) AS around FROM s),
v AS (SELECT slug, t, w, n, starts, list_transform(around, lambda x: CASE WHEN contains(x, 'of the') THEN 2 ELSE 0 END + len(regexp_extract_all(x, '\\bestion\\b'))) AS score FROM c),
b AS (SELECT slug, t, w, n, CASE WHEN len(score) > 0 THEN starts[list_position(score, list_max(score))] END AS best FROM v),
x AS (SELECT slug, t, n, best, (CASE WHEN best > 0 THEN '… ' ELSE '' END) || array_to_string(w[best + 1:least(n, best + 29)], ' ') || (CASE WHEN least(n, best + 29) < n THEN ' …' ELSE '' END) AS whole FROM b)
SELECT slug, CASE WHEN best IS NULL THEN trim(regexp_replace(left(t, 320), '\\s+', ' ', 'g'))
  WHEN length(whole) > 320 THEN regexp_replace(trim(left(whole, 320)), '\\s+\\S*$', '') || '…' ELSE whole END AS snippet FROM x"""
_COS = "list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))"
VEC = f"""vec AS (SELECT doc_id, slug, {_COS} AS cosine FROM (
  SELECT doc_id, slug, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS q FROM rec JOIN embeddings ON vec_id = doc_id))"""
SQL = {
    "q01_search_weighted_and": _sql(AND), "q02_search_or": _sql(OR), "q03_search_phrase": _sql(PHRASE), "q04_search_rrf": _sql(RRF),
    "q05_search_filters": _sql(FILTERED, True), "q11_paging_offset": _sql(PAGED),
    "q06_search_explain": f"""WITH {REC}, {_fields(_RRF20, 'r')}, pg AS (SELECT * FROM r WHERE rank <= 20), {_snippets(_RRF20.query, 'pg')},
e AS (SELECT rank, slug, raw, unnest([{", ".join("{'field': '" + f + "', 'score': " + f + "_score, 'evidence': " + ('snippet' if f == 'transcript' else f) + "}" for f in sorted(S.WEIGHTS))}]) AS p FROM pg JOIN snip USING (slug))
SELECT p.evidence AS evidence, rank, slug, p.field AS field, floor(p.score * 1e6 + 0.5) / 1e6 AS field_score, CASE WHEN raw > 0 THEN floor(p.score / raw * 100 + 0.5) / 100 ELSE 0 END AS share, floor(raw * 1e6 + 0.5) / 1e6 AS raw_score FROM e WHERE p.score IS NOT NULL""",
    "q07_compare_modes": f"""WITH {REC}, {_fields(S.Search("estion the"), 'a')}, {_fields(_RRF20, 'b')},
x AS (SELECT slug, rank FROM a WHERE rank <= 20), y AS (SELECT slug, rank FROM b WHERE rank <= 20)
SELECT coalesce(x.slug, y.slug) AS slug, x.rank AS weighted_rank, y.rank AS rrf_rank, (y.rank - x.rank)::INT AS rank_delta, x.slug IS NOT NULL AND y.slug IS NOT NULL AS in_both FROM x FULL JOIN y ON x.slug = y.slug""",
    "q08_snippet": SNIPPET_SQL,
    "q09_cosine_topk": f"WITH {REC}, {VEC} SELECT slug, floor(cosine * 1e6 + 0.5) / 1e6 AS cosine FROM (SELECT slug, cosine FROM vec ORDER BY cosine DESC, slug LIMIT 20)",
    "q10_rerank": f"""WITH {REC}, {VEC}, {_fields(S.Search("the and"), 'r')},
pool AS (SELECT r.slug, r.score AS k, coalesce(cosine, 0) AS c FROM r LEFT JOIN vec USING (slug) WHERE rank <= 100),
h AS (SELECT slug, 0.2::DOUBLE * (CASE WHEN (SELECT max(k) = min(k) FROM pool) THEN 0 ELSE (k - (SELECT min(k) FROM pool)) / ((SELECT max(k) FROM pool) - (SELECT min(k) FROM pool)) END) + 0.8::DOUBLE * greatest(0, least(1, (c + 1) / 2)) AS score FROM pool)
SELECT slug, floor(score * 1e6 + 0.5) / 1e6 AS score, true AS reranked, row_number() OVER (ORDER BY score DESC, slug) AS rank FROM h UNION ALL
SELECT slug, floor(score * 1e6 + 0.5) / 1e6, false, rank::BIGINT FROM r WHERE rank > 100""",
    "q01_search_scan": _sql(AND),
    "q51_index_upkeep": f"WITH {REC.replace('FROM documents)', 'FROM documents WHERE NOT coalesce(lang = $$en$$ AND doc_id % 5 = 0, false))')}, {_fields(S.Search('estion the', limit=50), 'r')} SELECT rank, slug, title, guest, publish_date, score, 'author:' || author_id AS source_id FROM r WHERE rank <= 50",
    "q52_engine_overlap": f"WITH {REC}, {', '.join(_fields(S.Search(q), f'o{i}') for i, q in enumerate(['estion the', '~of the~'.replace('~', chr(34)), 'en', 'zzzz']))} " + " UNION ALL ".join(f"SELECT '{q}' AS query, count(*) AS shared, 5::BIGINT AS \"of\" FROM o{i} WHERE rank <= 5" for i, q in enumerate(["estion the", '"of the"', "en", "zzzz"])),
    "q53_rerank_fallback": f"WITH {REC}, {_fields(AND, 'r')} SELECT rank, slug, score, true AS rerank_attempted, false AS rerank_applied, 'TimeoutError' AS rerank_reason FROM r WHERE rank <= 20",
    "q55_search_empty": f"WITH {REC} SELECT 1 AS rank, slug, title, guest, publish_date, 1.0::DOUBLE AS score, author_id AS source_id, '' AS snippet FROM rec WHERE false",
    "q48_embedding_cache_misses": f"WITH {REC} SELECT slug, left(sha256(content), 16) AS content_hash FROM rec WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "q49_postings": f"""WITH {REC}, f AS ({" UNION ALL ".join(f"SELECT slug, '{f}' AS field, {TOKENS.format(f)} AS w FROM rec" for f in S.WEIGHTS)}),
p AS (SELECT field, token, slug, min(pos) AS first_pos FROM (SELECT field, slug, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM f) GROUP BY ALL)
SELECT field, count(*) AS postings, count(DISTINCT token) AS tokens, sum(first_pos)::BIGINT AS positions FROM p GROUP BY field""",
    "q50_search_total": f"WITH {REC}, {_fields(OR, 'r')} SELECT count(*) AS total FROM r",
}
SQL["q54_search_reranked"] = f"SELECT rank::INT AS rank, slug, score, true AS rerank_applied, NULL::VARCHAR AS rerank_reason FROM ({SQL['q10_rerank']}) WHERE rank <= 50"
SQL["q56_rerank_deadline"] = SQL["q53_rerank_fallback"]
