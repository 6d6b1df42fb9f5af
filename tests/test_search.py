"""Queries, ranking, snippets and rerank on small rows."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions.query import normalize_query, parse_query
from folioscope.operators import rerank as R
from folioscope.operators import search as S
from folioscope.operators.snippet import with_snippet


def test_queries():
    q = parse_query("growth loops")
    assert q.terms == ("growth", "loops") and not q.any_term
    q = parse_query('“product market” fit')
    assert q.phrases == ("product market",) and q.terms == ("fit",)
    q = parse_query("alpha or beta")
    assert q.any_term and q.terms == ("alpha", "beta")
    assert not parse_query("normal floor").any_term
    assert parse_query('a "b" c').empty
    assert normalize_query("Don't  STOP—now!") == "don't stop now"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("author:a:title-only", "a", "Alpha", "Ann", ["x"], None, "nothing here"),
        ("author:a:repeat", "a", "Other", "Ben", ["y"], "2024-03-01", "alpha alpha alpha alpha"),
        ("author:a:balanced", "a", "Alpha notes", "Cem", ["alpha"], "2024-05-01", "some words on alpha"),
        ("author:b:prefix", "b", "Alphabet", "Dee", [], "2024-05-02", "alphabet soup"),
    ]
    return spark.createDataFrame(rows, "slug string, author_id string, title string, guest string, keywords array<string>, publish_date string, transcript string")


def slugs(df):
    return [r["slug"].split(":")[2] for r in df.orderBy("rank").collect()]


def test_weighted_and_rrf_agree_on_the_best(docs):
    for mode in ("weighted", "rrf"):
        got = S.search(docs, S.Search("alpha", mode=mode))
        assert slugs(got)[0] == "balanced"
        assert got.where("slug like '%prefix'").count() == 0  # a prefix scores, but is no member
        assert got.orderBy("rank").first()["score"] == 1.0


def test_filters_and_pages(docs):
    assert slugs(S.search(docs, S.Search("alpha", guest="BEN"))) == ["repeat"]
    assert slugs(S.search(docs, S.Search("alpha", from_date="2024-04-01"))) == ["balanced", "title-only"]  # no date passes
    assert slugs(S.search(docs, S.Search("alpha", limit=1, page=2))) == [slugs(S.search(docs, S.Search("alpha")))[1]]
    assert S.Search("x", limit=99).window() == (0, 50) and S.Search("x", limit=0).window() == (0, 1)
    assert S.search(docs, S.Search("a")).count() == 0
    assert S.search(docs, S.Search('"words on"')).count() == 1
    assert S.search(docs, S.Search("alph? alpha")).count() == 0  # such a term is no word
    assert slugs(S.search(docs, S.Search("soup OR notes"))) == ["balanced", "prefix"]


def test_explain_and_compare(docs):
    rows = S.explain(docs, S.Search("alpha")).where("slug like '%balanced'").collect()
    assert {r["field"]: r["share"] for r in rows} == {"title": 0.5, "keywords": 0.38, "transcript": 0.13}
    assert all(r["raw_score"] == 8 for r in rows)
    both = {r["slug"].split(":")[2]: r for r in S.compare(docs, S.Search("alpha")).collect()}
    assert both["balanced"]["in_both"] and both["balanced"]["rank_delta"] == both["balanced"]["rrf_rank"] - both["balanced"]["weighted_rank"]


def test_snippets(spark):
    long = " ".join(f"w{i}" for i in range(60)) + " alpha beta " + " ".join(f"v{i}" for i in range(60)) + " alpha"
    df = spark.createDataFrame([(1, long), (2, "short text"), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r["snippet"] for r in with_snippet(df, "t", "alpha beta").collect()}
    assert "alpha beta" in got[1] and got[1].startswith("… ") and got[1].endswith(" …")
    assert got[2] == "short text" and got[3] == "" and got[4] == ""
    assert with_snippet(df, "t", "zzz").where("id = 1").first()["snippet"].startswith("w0 w1")


def test_rerank(spark):
    rows = spark.createDataFrame([("a", 10.0, 0.1), ("b", 20.0, 0.9)], "slug string, keyword_score double, semantic_score double")
    got = {r["slug"]: round(r["score"], 6) for r in R.rerank_scores(rows).collect()}
    assert got == {"a": 0.44, "b": 0.96}
    results = spark.range(120).select(F.concat(F.lit("doc-"), F.lpad("id", 3, "0")).alias("slug"), (1 - F.col("id") / 1000).alias("score"))
    vectors = results.select("slug", F.array(F.lit(1.0), F.substring("slug", 5, 3).cast("double")).alias("vector"))
    out = R.rerank(results, vectors, [0.0, 1.0])
    assert out.where("reranked").count() == 100 and out.where("rank > 100").count() == 20
    assert out.orderBy("rank").first()["slug"] != "doc-000"
    bad = spark.createDataFrame([("a", [1.0]), ("b", None)], "slug string, vector array<double>")
    with pytest.raises(Exception, match="differ in length"):
        R.nearest(bad, [1.0, 2.0], 2).collect()
    assert R.nearest(bad.where("slug = 'b'"), [1.0, 2.0], 2).first()["cosine"] is None
