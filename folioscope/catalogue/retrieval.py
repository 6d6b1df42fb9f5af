"""BM25, substrings and near spellings over indexes that are kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..operators.relevance import Bm25
from ..operators.spelling import neighbours, suggestions
from ..operators.substrings import Trigrams
from ..plans import corpus as C
from .prelude import REC

QUERY = "estion thonre oureaié blewhed"
PART = "nd the o"


def _index(kind, name: str):
    def made(spark: SparkSession, sf_dir: str):
        docs = C.records(spark, sf_dir).select("slug", F.concat_ws("\n", "title", "guest", "transcript").alias("text"))
        key = storage.fingerprint(C.table(spark, sf_dir, "documents"))
        root = f"{storage.shared_folder(spark)}/folioscope-{name}-{kind.FORMAT}-{key}"
        return kind.open(spark, root, key) or kind.build(docs, root, key)

    return made


bm25, trigrams = _index(Bm25, "bm25"), _index(Trigrams, "trigrams")


def q82(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir).top(QUERY, 30).select("rank", "slug", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


def q83(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams(spark, sf_dir).holding(PART)


def q84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that no document has, with documents' words that are near."""
    words = C.table(spark, sf_dir, "benchmark").select(F.explode(T.word_set(F.coalesce("text", F.lit("")))).alias("word")).distinct()
    return suggestions(words, bm25(spark, sf_dir).table("words"))


def q85(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' rare words of some length that are one letter from a frequent one."""
    words = bm25(spark, sf_dir).table("words")
    rare = words.where("df = 1 and length(token) = 6").select(F.col("token").alias("word"))
    return neighbours(rare, words.where("df >= 20"), 1).select("word", "token", "distance")


QUERIES = {"q82_bm25_topk": q82, "q83_substring": q83, "q84_suggestions": q84, "q85_misspelled": q85}

_TEXT = "title || chr(10) || guest || chr(10) || transcript"
_WORDS = f"w AS (SELECT slug, regexp_extract_all(lower({_TEXT}), '[\\p{{L}}\\p{{N}}]+') AS w FROM rec)"
_VOCABULARY = "v AS (SELECT token, count(*)::BIGINT AS df FROM (SELECT DISTINCT slug, unnest(w) AS token FROM w) GROUP BY token)"
# DuckDB's distance is one of bytes; the tables' letters beyond ASCII are written as capitals, of which the words have none.
_ODD = "ßáâäçèéêíîñóöúü"
_NEAR = f"levenshtein(translate({{0}}, '{_ODD}', '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[: len(_ODD)]}'), translate({{1}}, '{_ODD}', '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[: len(_ODD)]}'))"
_TERMS = sorted(set(QUERY.split()))


def _score(i: int, term: str) -> str:
    return f"CASE WHEN tf[{i + 1}] > 0 THEN tf[{i + 1}] * 2.2::DOUBLE / (tf[{i + 1}] + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean)) * (SELECT ln(1 + (n - df[{i + 1}] + 0.5::DOUBLE) / (df[{i + 1}] + 0.5::DOUBLE)) FROM s) ELSE 0 END"


SQL = {
    "q82_bm25_topk": f"""WITH {REC}, {_WORDS},
t AS (SELECT slug, len(w)::DOUBLE AS len, [{", ".join(f"len(list_filter(w, lambda x: x = '{t}'))" for t in _TERMS)}] AS tf FROM w),
s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, [{", ".join(f"count(*) FILTER (WHERE tf[{i + 1}] > 0)" for i in range(len(_TERMS)))}] AS df FROM t),
r AS (SELECT slug, {" + ".join(_score(i, t) for i, t in enumerate(_TERMS))} AS score FROM t, (SELECT mean FROM s) WHERE list_sum(tf) > 0)
SELECT row_number() OVER (ORDER BY score DESC, slug)::INT AS rank, slug, floor(score * 1e6 + 0.5) / 1e6 AS score FROM r QUALIFY rank <= 30""",
    "q83_substring": f"""WITH {REC}, t AS (SELECT slug, lower({_TEXT}) AS text FROM rec)
SELECT slug, ((length(text) - length(replace(text, '{PART}', ''))) // {len(PART)})::BIGINT AS n, instr(text, '{PART}')::BIGINT AS first FROM t WHERE contains(text, '{PART}')""",
    "q84_suggestions": f"""WITH {REC}, {_WORDS}, {_VOCABULARY},
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark)
SELECT word, token, {_NEAR.format('word', 'token')}::INT AS distance, df FROM (SELECT * FROM b WHERE word NOT IN (SELECT token FROM v)) b, v
WHERE abs(length(word) - length(token)) <= 2 AND {_NEAR.format('word', 'token')} <= 2""",
    "q85_misspelled": f"""WITH {REC}, {_WORDS}, {_VOCABULARY}
SELECT a.token AS word, b.token, {_NEAR.format('a.token', 'b.token')}::INT AS distance FROM v a, v b
WHERE a.df = 1 AND length(a.token) = 6 AND b.df >= 20 AND length(b.token) BETWEEN 5 AND 7 AND {_NEAR.format('a.token', 'b.token')} <= 1""",
}
