"""Event logs, exports, limits and streams."""

from pyspark.sql import functions as F

from folioscope.operators import catalog as K
from folioscope.operators import export as E
from folioscope.operators import lifecycle as L
from folioscope.operators import observability as O
from folioscope.streaming import streams

LOG = [
    '{"sourceId":"author:a","action":"import","at":"2024-01-01T00:00:00Z","documentCount":2}',
    "not json",
    '{"sourceId":"author:a","action":"rename","at":"2024-01-01T00:00:00Z"}',
    '{"sourceId":123,"action":"import","at":"2024-01-01T00:00:00Z"}',
    "  ",
    '{"sourceId":"author:b","action":"refresh","at":"2023-01-01T00:00:00Z"}',
    '{"sourceId":"author:a","action":"delete","at":"2022-01-01T00:00:00Z","documentCount":"2"}',
    '{"sourceId":"author:a","action":"refresh","at":"2021-01-01T00:00:00Z","documentCount":3}',
    "[1]",
]


def lines(spark, log=LOG):
    return spark.createDataFrame(list(enumerate(log, 1)), "line long, value string")


def test_events(spark):
    events = L.parse_events(lines(spark))
    assert events.where("malformed").count() == 5 and L.valid(events).count() == 3
    a = L.summarize(events).where("source_id = 'author:a'").first()
    assert (a["interaction_count"], a["last_action"], a["last_seen_at"]) == (2, "refresh", "2021-01-01T00:00:00Z")  # order of lines, not of times
    assert L.status(events).first()["malformed_event_count"] == 5
    assert [r["line"] for r in L.history(events, None, 1, 1).collect()] == [6]
    assert L.history(events, None, 0, 0).count() == 0


def test_compaction(spark):
    burst = [f'{{"sourceId":"author:a","action":"refresh","at":"2024-01-01T00:00:{i:02d}Z"}}' for i in range(30)] + ["bad", '{"sourceId":"author:b","action":"import","at":"x"}']
    events = L.parse_events(lines(spark, burst))
    kept = L.compact(events, 5, "author:a")
    assert sorted(r["line"] for r in kept.collect()) == [26, 27, 28, 29, 30, 32]
    assert L.compact(events, 5).count() == 6
    r = L.compaction_record(events, 5).where("source_id = 'author:a'").first()
    assert (r["retained"], r["removed"], r["skipped_malformed"]) == (5, 25, 1)


def test_export(spark):
    def sums(url):
        docs = spark.createDataFrame([("author:a:x", "a", "X", "body", url), ("author:a:y", "a", "Y", None, None)], "slug string, author_id string, title string, content string, original_url string")
        return E.export_manifest(E.export_documents(docs)).first()

    one, again, other = sums("http://1"), sums("http://1"), sums("http://2")
    assert one == again and one["document_set_checksum"] == other["document_set_checksum"]
    assert one["provenance_checksum"] != other["provenance_checksum"] and one["bundle_checksum"] != other["bundle_checksum"]


def test_changes(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "")], "slug string, hash string")
    incoming = spark.createDataFrame([("a", "A", "1", 1), ("b", "B", "3", 2), ("d", "D", "4", 3), ("d", "D", "5", 4), ("d", "D", "5", 5)], "slug string, title string, hash string, ord int")
    got = sorted((r["slug"], r["action"]) for r in K.changeset(stored, incoming).collect())
    assert got == [("a", "skipped"), ("b", "updated"), ("d", "added"), ("d", "skipped"), ("d", "updated")]
    assert {r["slug"]: r["hash"] for r in K.upsert(stored, incoming).collect()} == {"a": "1", "b": "3", "c": "", "d": "5"}
    changes = K.diff(stored, K.latest_wins(incoming.select("slug", "hash").limit(2), spark.createDataFrame([("c", "9")], "slug string, hash string")))
    assert {(r["slug"], r["change"]) for r in changes.collect()} == {("b", "changed"), ("c", "added")}
    assert K.update_plan(changes, changes.limit(0)).first()["mode"] == "incremental" and K.update_plan(changes, changes).first()["mode"] == "full"


def test_limits(spark):
    rows = [(i, "a", i * 10_000_000) for i in range(10)] + [(99, "b", 0)]
    df = spark.createDataFrame(rows, "id long, client string, micros long")
    got = {r["id"]: (r["allowed"], r["retry_after"]) for r in O.rate_limit(df, limit=2, window_s=35).collect()}
    assert [got[i][0] for i in range(10)] == [True, True, False, False, True, True, False, False, True, True] and got[2] == (False, 15) and got[99] == (True, 0)
    assert O.recent_requests(df, window_s=35).where("id = 5").first()["recent"] == 4


def test_streams(spark, tmp_path):
    lines(spark).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("line long, value string").parquet(str(tmp_path / "in"))
    q = streams.summary_stream(source).writeStream.format("memory").queryName("summary").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["source_id"]: r["last_action"] for r in L.summarize(L.parse_events(lines(spark))).collect()}
    assert {r["source_id"]: r["last_action"] for r in spark.table("summary").collect()} == want
    rows = spark.range(10).select("id", F.lit("a").alias("client"), (F.col("id") * 10_000_000 + 1_700_000_000_000_000).alias("micros"))
    rows.coalesce(1).write.parquet(str(tmp_path / "req"))
    source = spark.readStream.schema("id long, client string, micros long").parquet(str(tmp_path / "req"))
    q = streams.rate_limit_stream(source, 2, 35).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    got = {r["id"]: r["allowed"] for r in spark.table("limits").collect()}
    assert got == {r["id"]: r["allowed"] for r in O.rate_limit(rows, limit=2, window_s=35).collect()}
