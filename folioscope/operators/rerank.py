"""Semantic rerank of the best keyword results by vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V

POOL = 100
# Shares of the keyword and the semantic score.
KEYWORD_SHARE, SEMANTIC_SHARE = 0.2, 0.8
KEY = ["slug", "content_hash", "provider", "model", "dimension"]


def rerank_scores(rows: DataFrame) -> DataFrame:
    """``rows(slug, keyword_score, semantic_score)`` with ``score``: the keyword score over the pool's
    range and the cosine on 0..1, in fixed shares."""
    range_ = rows.agg(F.min("keyword_score").alias("low"), F.max("keyword_score").alias("high"))
    scored = rows.crossJoin(F.broadcast(range_))  # one row
    keyword = V.min_max(F.col("keyword_score"), F.col("low"), F.col("high"))
    return scored.withColumn("score", KEYWORD_SHARE * keyword + SEMANTIC_SHARE * V.unit_interval(F.col("semantic_score"))).drop("low", "high")


def rerank(results: DataFrame, vectors: DataFrame, query_vector: list[float], pool: int = POOL) -> DataFrame:
    """``results(slug, score)`` and ``vectors(slug, vector)``; returns slug, score, reranked, rank.

    The best ``pool`` results are scored anew and come first; the others follow in their order with
    their scores. A pooled result without a vector counts as a cosine of 0.
    """
    order = Window.orderBy(F.desc("score"), "slug")
    best = results.orderBy(F.desc("score"), "slug").limit(pool)
    near = V.cosine(F.col("vector"), F.array(*map(F.lit, map(float, query_vector))))
    met = best.join(vectors.select("slug", "vector"), "slug", "left")
    scored = rerank_scores(met.select("slug", F.col("score").alias("keyword_score"), F.coalesce(near, F.lit(0.0)).alias("semantic_score")))
    head = scored.select("slug", "score", F.lit(True).alias("reranked")).withColumn("rank", F.row_number().over(order))
    tail = results.join(best.select("slug"), "slug", "left_anti").select("slug", "score", F.lit(False).alias("reranked"))
    tail = tail.withColumn("rank", F.row_number().over(order) + pool)
    return head.unionByName(tail)


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of ``wanted`` for which no vector of the same text, provider, model and dimension is kept."""
    return wanted.join(cached.select(*KEY), KEY, "left_anti")


def resolve(wanted: DataFrame, cached: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors from the cache, and from ``provider`` for those that it lacks."""
    known = wanted.join(cached.select(*KEY, "vector"), KEY)
    return known.unionByName(provider(cache_misses(wanted, cached)).select(*known.columns))


def nearest(vectors: DataFrame, query_vector: list[float], k: int) -> DataFrame:
    near = V.cosine(F.col("vector"), F.array(*map(F.lit, map(float, query_vector))))
    return vectors.select("slug", near.alias("cosine")).orderBy(F.desc("cosine"), "slug").limit(k)
