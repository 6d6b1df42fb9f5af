"""What an overlap join sends through the driver, and what sums by pairs shuffle."""

import random

from pyspark.sql import functions as F
from test_index_shuffles import rows_shuffled

from folioscope.catalogue import analytics
from folioscope.operators import intervals
from folioscope.operators.intervals import overlapping


def test_no_side_of_an_overlap_join_is_broadcast(spark):
    """Few rows make many points and levels, of which no size is known: neither side goes through the driver, however small it looks."""
    rows = spark.range(400).select("id", (F.col("id") * 7).alias("start"), (F.col("id") * 7 + F.col("id") % 90).alias("end"))
    found = overlapping(rows, rows).where("left.id < right.id")
    assert found.count() == sum(1 for a in range(400) for b in range(a + 1, 400) if b * 7 <= a * 7 + a % 90)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_shared_times_are_those_of_all_pairs(spark, monkeypatch):
    """Keys over several blocks, intervals of a key in several steps, repeated rows and odd ones: as by comparing all pairs."""
    rng = random.Random(3)
    spans = [(rng.choice([-5, 0, 2**40]) + rng.randint(0, 9), s, s + rng.choice([-1, 0, 0, 1, 9, 10**13])) for s in (rng.choice([0, 7, -4, rng.randint(0, 300)]) for _ in range(180))]
    odd = [(None, 0, 9), (1, None, 9), (1, 0, None)]
    want = {}
    for a, s, e in spans:
        for b, t, f in spans:
            if a < b and s <= e and t <= f and s <= f and t <= e:
                n, total = want.get((a, b), (0, 0))
                want[a, b] = n + 1, total + min(e, f) - max(s, t)
    rows = spark.createDataFrame(spans + odd, "k long, start long, end long")
    for few, many, pairs in ((50_000, 1_000_000, 1_000_000), (1, 40, 7), (50_000, 40, 100)):
        monkeypatch.setattr(intervals, "FEW", few)
        monkeypatch.setattr(intervals, "MANY", many)
        monkeypatch.setattr(intervals, "PAIRS", pairs)
        monkeypatch.setattr(intervals, "ROWS", 5)
        got = [tuple(r) for r in intervals.shared(rows, "k").collect()]
        assert sorted(got) == sorted((*k, *v) for k, v in want.items()) and len(want) > 100
    assert intervals.shared(rows.limit(0), "k").collect() == []


def test_pairs_of_concurrent_sessions_are_not_shuffled(spark, tmp_path):
    """A session a user, all at once: 44,850 pairs of 300 sessions, none of which is written to a shuffle."""
    rows = spark.range(600).select((F.col("id") % 300).alias("user_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    _, since = rows_shuffled(spark, -1)
    assert analytics.q87(spark, str(tmp_path)).groupBy("sessions").count().collect() == [(1, 300 * 299 // 2)]
    shuffled, _ = rows_shuffled(spark, since)
    assert shuffled < 10_000
