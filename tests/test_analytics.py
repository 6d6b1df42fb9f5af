"""Overlaps, groupings, sketches, table functions, deadlines and streams against plain code."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope import storage
from folioscope.functions import tables
from folioscope.operators import ingest as I
from folioscope.operators import search as S
from folioscope.operators import summaries as Y
from folioscope.operators.deadline import within
from folioscope.operators.engine import IndexEngine
from folioscope.operators.intervals import overlapping
from folioscope.streaming import streams as X


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)
    spans = lambda n, k: [(i, rng.choice(["g", "h", None]), s, s + rng.choice([-1, 0, 0, 1, 7, 40, 3000, 10**12])) for i in range(n) for s in [rng.choice([0, 1, 7, 8, rng.randint(0, 4000), 10**12])]] + [(n, "g", None, 3), (n + 1, "g", 2, None)]  # noqa: E731, ARG005
    one, two = spans(150, 0), spans(150, 1)
    schema = "id int, grp string, start long, end long"
    left, right = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    meets = lambda a, b: None not in (a[2], a[3], b[2], b[3]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]
    for group in (None, "grp"):
        found = overlapping(left, right, group=group)
        got = sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect())
        assert got == sorted((a[0], b[0]) for a in one for b in two if meets(a, b) and (group is None or a[1] == b[1] is not None))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlapping(left.limit(0), right).count() == 0


def test_facets_take_one_shuffle_of_the_rows(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 4), ("a", "x", 8)], "one string, two string, n int")
    got = {(r["one"], r["two"], r["grouping_id"]): (r["n"], r["s"]) for r in Y.facets(rows, [["one", "two"], ["two"], []], s="n").collect()}
    assert got == {("a", "x", 0): (2, 9), ("a", None, 0): (1, 2), (None, "x", 0): (1, 4), (None, "x", 2): (3, 13), (None, None, 2): (1, 2), (None, None, 3): (4, 15)}
    assert Y.facets(rows.limit(0), [["one"]], s="n").count() == 0


def test_merged_sketches_say_what_one_says(spark):
    rows = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("part"), (F.col("id") % 50_000).alias("word"), (F.col("id") % 1000).alias("n"))
    by_part = Y.sketched(rows, ["part"], "word", "n")
    again = by_part.where("part < 3").unionByName(by_part.where("part >= 3"))  # kept, and added to
    merged = Y.estimates(Y.merged(again, []), 0.5, 0.9).first()
    once = Y.estimates(Y.sketched(rows, [], "word", "n"), 0.5, 0.9).first()
    assert merged["n"] == once["n"] == 200_000 and merged["distinct_count"] == pytest.approx(once["distinct_count"], rel=0.02) == pytest.approx(50_000, rel=0.07)
    for found in (merged, once):
        assert abs(found["p50"] - 500) <= 1000 * 2 * Y.RANK_ERROR and abs(found["p90"] - 900) <= 1000 * 2 * Y.RANK_ERROR


def test_split_by_from_sql(spark):
    rows = [(1, "before\n## One\ntext\n## Two\nmore"), (2, "none"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    tables.register(spark)
    df.createOrReplaceTempView("split_texts")
    got = spark.sql("SELECT id, ord, title, body FROM split_texts, LATERAL split_by(t, '^## (.+)$')").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, I.sections_by(df, "id", "t", r"^## (.+)$").collect()))
    assert spark.sql("SELECT * FROM split_by('x', 'y', 'my_')").columns == ["my_ord", "my_title", "my_body"]
    for bad in ("'('", "cast(null as string)"):
        with pytest.raises(Exception, match="pattern"):
            spark.sql(f"SELECT * FROM split_by('x', {bad})").collect()


def test_deadline(spark):
    assert within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 / 0)
    docs = spark.createDataFrame([("author:a:x", "a", "Alpha", "G", ["k"], "2024-01-01", "alpha words")], "slug string, author_id string, title string, guest string, keywords array<string>, publish_date string, transcript string")

    def endless(rows):
        while True:  # starts jobs for ever, each of them long
            rows.select(F.expr("reflect('java.lang.Thread', 'sleep', 600000L)")).collect()

    began = time.monotonic()
    rows = S.search(docs, S.Search("alpha"), reranker=endless, deadline_s=1).collect()
    assert time.monotonic() - began < 30 and [(r["rank"], r["rerank_applied"], r["rerank_reason"]) for r in rows] == [(1, False, "TimeoutError")]
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_sessions_replayed_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(0, 5), rng.randint(0, 200) * 600 + rng.random()) for _ in range(400)] + [(None, 5.0), (3, None)]
    df = spark.createDataFrame(rows, "user_id long, s double").select("user_id", F.timestamp_seconds("s").alias("ts"))
    want = sorted(map(tuple, X.sessions(df).collect()))
    out = spark.read.parquet(X.replayed(df, f"file://{tmp_path}/replay", 5, "30 days")).where("user_id >= 0")
    assert sorted(map(tuple, out.select("user_id", "started", "ended", "events").collect())) == want
    plain, n = 0, 0
    for user in range(6):
        times = sorted(s for u, s in rows if u == user and s is not None)
        plain += sum(i == 0 or t - times[i - 1] > 1800 for i, t in enumerate(times))
        n += len(times)
    assert len(want) == plain and sum(r[3] for r in want) == n


def test_index_kept_by_a_stream_that_dies(spark, tmp_path, monkeypatch):
    """A batch that fails between its tables and the index's state is done again, and counts once."""
    schema = "slug string, author_id string, title string, guest string, keywords array<string>, publish_date string, transcript string"
    rows = [(f"author:a:d{i}", "a", f"alpha {i}", "G", ["k"], "2024-01-01", f"alpha words number {i}") for i in range(12)]
    first, second = spark.createDataFrame(rows[:8], schema), spark.createDataFrame([(*r[:2], "changed", *r[3:]) for r in rows[4:]], schema)
    root, folder = f"file://{tmp_path}/index", f"file://{tmp_path}/in"
    IndexEngine.build(first.limit(0), root, "k")
    first.coalesce(1).write.parquet(folder)
    run = lambda: X.index_stream(spark.readStream.schema(schema).parquet(folder), root, "docs", f"file://{tmp_path}/state").start().awaitTermination()
    run()
    second.coalesce(1).write.mode("append").parquet(folder)
    write = storage.write_text
    monkeypatch.setattr(storage, "write_text", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(Exception, match="gone"):
        run()
    monkeypatch.setattr(storage, "write_text", write)
    run()
    index = IndexEngine.open(spark, root)
    assert len(index.state["segments"]) == 3 and index.add_batch(first, "docs", 0) is index
    rebuilt = first.where("slug in ('author:a:d0', 'author:a:d1', 'author:a:d2', 'author:a:d3')").unionByName(second)
    for query in ("alpha", "changed", "number"):
        wanted = S.Search(query, limit=50)
        assert [tuple(r) for r in S.search(index, wanted).orderBy("rank").collect()] == [tuple(r) for r in S.search(rebuilt, wanted).orderBy("rank").collect()]
