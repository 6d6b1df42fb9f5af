"""What the making of an index shuffles: documents, and none of the many rows that are made of their words."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import engine as E
from folioscope.operators import search as S


def rows_shuffled(spark, since):
    """Rows that stages after ``since`` wrote to shuffles."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    found = [(s.stageId(), s.shuffleWriteRecords()) for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)]
    return sum(n for k, n in found if k > since), max((k for k, _ in found), default=-1)


@pytest.fixture(scope="module")
def docs(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.concat(F.lit("w"), ((F.col("id") * k) % 211).cast("string"))))
    rows = spark.range(300).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("slug"), text.alias("text"), "id")
    return rows.localCheckpoint()


def test_postings_are_not_shuffled(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "DOCUMENTS_A_PART", 100)
    monkeypatch.setattr(E, "LETTERS_A_TASK", 20_000)
    rows = docs.select("slug", F.lit("a").alias("author_id"), F.lit("t one").alias("title"), F.lit("g").alias("guest"), F.array(F.lit("k")).alias("keywords"), F.lit("2024-01-01").alias("publish_date"), F.col("text").alias("transcript"))
    rows = rows.unionByName(rows.where("slug = 'd7'").withColumn("transcript", F.lit("zz w1"))).localCheckpoint()  # a slug that stands twice
    _, since = rows_shuffled(spark, -1)
    index = E.IndexEngine.build(rows, f"file://{tmp_path}/i", "k")
    n = index.postings().count()
    assert n > 20_000
    shuffled, _ = rows_shuffled(spark, since)
    assert shuffled < 5 * 301
    plain = lambda df: sorted(map(tuple, df.select("field", "token", "slug", F.col("first_pos").cast("int")).collect()))
    assert plain(index.postings()) == plain(S.postings(rows))


def test_words_of_bm25_are_not_shuffled(spark, docs, tmp_path, monkeypatch):
    from folioscope.operators import relevance as R

    monkeypatch.setattr(R, "WORDS_A_TASK", 10_000)
    _, since = rows_shuffled(spark, -1)
    odd = spark.createDataFrame([("e0", None), ("e1", ""), ("e2", "?"), (None, "x y x")], "slug string, text string")
    rows = docs.select("slug", "text").unionByName(odd).localCheckpoint()
    index = R.Bm25.build(rows, f"file://{tmp_path}/b", "k", block=2)
    words = index.table("words").count()
    shuffled, _ = rows_shuffled(spark, since)
    assert 200 < words < 300 and shuffled < 3_000 + 8 * 25 * words  # a row a document, and words by task; the occurrences are 60,000
    plain = rows.select("slug", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token")).groupBy("slug", "token").agg(F.count("*").alias("tf"))
    got = index.table("postings").select("token", "documents", F.size("entries").alias("n"), F.inline("entries"))
    assert got.where("documents <> n").count() == 0
    assert sorted(map(repr, got.select("slug", "token", "tf").collect())) == sorted(map(repr, plain.collect()))
    assert R.Bm25.build(rows.where("slug like 'e%'"), f"file://{tmp_path}/none", "k").top("x").count() == 0


def test_trigrams_are_not_shuffled(spark, docs, tmp_path, monkeypatch):
    from folioscope.operators import substrings as B

    monkeypatch.setattr(B, "LETTERS_A_TASK", 60_000)
    _, since = rows_shuffled(spark, -1)
    index = B.Trigrams.build(docs.select("slug", "text"), f"file://{tmp_path}/g", "k", folder=100)
    made, counts = index.table("grams").count(), index.table("counts").count()
    shuffled, _ = rows_shuffled(spark, since)
    assert made > 60_000 and shuffled < 2_000 + 20 * counts < made
    assert index.table("grams").distinct().count() == made


def test_trigrams_are_kept_as_lists(spark, docs, tmp_path):
    """A trigram is kept once for some thousand texts, not once a text, and texts are dealt out once."""
    from folioscope.operators import substrings as B

    _, since = rows_shuffled(spark, -1)
    index = B.Trigrams.build(docs.select("slug", "text"), f"file://{tmp_path}/g", "k", folder=100)
    shuffled, _ = rows_shuffled(spark, since)
    made, counts = index.table("grams").count(), index.table("counts").count()
    assert spark.read.parquet(f"file://{tmp_path}/g/grams").count() <= 4 * counts < made / 10
    assert 300 < shuffled < 600 + 5 * counts


def test_trigrams_of_odd_texts(spark, tmp_path, monkeypatch):
    """Texts in several pieces and one in many, letters of all planes, so many letters that their numbers don't fit: each trigram of a text once."""
    from folioscope.operators import substrings as B

    wide = ["".join(chr(c) for c in range(k, 0x110000, 6) if not 0xD800 <= c < 0xE000) for k in range(6)]
    trigrams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    texts = ["", None, "ab", "abc", "abcabcabc", "zé😀zé😀", "line\nbreak\x00 ", "y" * 500, "".join(chr(97 + k % 23) for k in range(400)), "x😀" * 90]
    for some, letters, entries in ((texts, 50, 7), (texts + wide[:1], 4_000_000, 500_000)):
        monkeypatch.setattr(B, "LETTERS", letters)
        monkeypatch.setattr(B, "ENTRIES", entries)
        rows = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(some)], "slug string, text string")
        index = B.Trigrams.build(rows, f"file://{tmp_path}/{letters}", "k", folder=100)
        lowered = {r["slug"]: r["text"] for r in index.table("texts").collect()}
        doc = {r["doc"]: r["slug"] for r in rows.select("slug", F.xxhash64("slug").alias("doc")).collect()}
        got = sorted((doc[r["doc"]], r["gram"]) for r in index.table("grams").collect())
        assert got == sorted((s, g) for s, t in lowered.items() for g in trigrams(t))
        assert {r["gram"]: r["n"] for r in index.table("counts").collect()} == dict(Counter(g for _, g in got))
    found = list(B.gram_lists(np.arange(6), wide, 10**5))
    assert len(found) > 1 and sorted((d, g) for grams, at, docs in found for i, g in enumerate(grams) for d in docs[at[i] : at[i + 1]]) == sorted((d, g) for d, t in enumerate(wide) for g in trigrams(t))


@pytest.mark.parametrize("few", [1000, 3])
def test_keys_of_tokens_stay_where_they_are(spark, monkeypatch, few):
    """Few words, of whatever size Spark takes them to be, are sent to the tokens; more are joined as before, with the same pairs."""
    from folioscope.operators import spelling

    monkeypatch.setattr(spelling, "FEW", few)
    tokens = spark.range(3000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("token")).localCheckpoint()
    words = spark.createDataFrame([("word12",), ("wird2999",)], "word string").localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, since = rows_shuffled(spark, -1)
        found = spelling.neighbours(words, tokens, 1).collect()
        shuffled, _ = rows_shuffled(spark, since)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("wird2999", "word2999", 1) in {tuple(r) for r in found} and len(found) == 1 + (1 + 2 + 17 + 27)  # itself, a letter less, another, more
    assert (shuffled < 10_000) == (few == 1000)
