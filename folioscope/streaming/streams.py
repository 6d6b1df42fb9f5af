"""Streams. The batch operators are the reference point: over the same rows they give the same."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import parse_events, valid
from ..operators.observability import BOUNDS, LIMIT, WINDOW_S, Limiter
from ..workers import importable


def summary_stream(lines: DataFrame) -> DataFrame:
    """Per source the number of events and the last by line; for output modes complete and update."""
    return valid(parse_events(lines)).groupBy("source_id").agg(F.count("*").alias("interaction_count"), F.max_by("at", "line").alias("last_seen_at"), F.max_by("action", "line").alias("last_action"))


def latency_stream(requests: DataFrame, time: str = "ts", seconds: str = "seconds", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Cumulative latency buckets of each window of event time; rows later than ``late`` are dropped."""
    rows = requests.withWatermark(time, late).groupBy(F.window(time, window))
    return rows.agg(*(F.count_if(F.col(seconds) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BOUNDS), F.count(seconds).alias("requests"))


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """``requests(id, client, micros)`` with allowed and retry_after; a client's state is the times of the
    requests let through in the last window, and goes when the stream is two windows past its last.
    Requests that come later than a window are dropped."""
    importable(requests.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Limiter(list(state.get[0]) if state.exists else None, limit, window_s)
        for rows in [pd.concat(list(batches)).sort_values(["micros", "id"])]:
            said = [own.ask(int(m)) for m in rows["micros"]]
            yield pd.DataFrame({"id": rows["id"], "client": key[0], "micros": rows["micros"], "allowed": [a for a, _ in said], "retry_after": [w for _, w in said]})
        state.update((own.times,))
        last = max(own.times, default=0) // 1000 + 2 * window_s * 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    rows = requests.select(F.col("id").cast("long").alias("id"), F.col("client").cast("string").alias("client"), F.col("micros").cast("long").alias("micros"))
    rows = rows.withColumn("at", F.timestamp_micros("micros")).withWatermark("at", f"{window_s} seconds")
    return rows.groupBy("client").applyInPandasWithState(step, "id long, client string, micros long, allowed boolean, retry_after long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, started, ended, events): a key's events with no pause longer than ``gap``; ``ended`` is the last event's time.

    Of a stream, give it a watermark first; a session comes out when the watermark has passed its end by the gap, once and for
    all, and rows later than the watermark aren't counted. Rows without a time or a key are in no session.
    """
    rows = events.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    found = rows.groupBy(F.col(key), F.session_window(time, gap)).agg(F.count("*").alias("events"), F.min(time).alias("started"), F.max(time).alias("ended"))
    return found.select(key, "started", "ended", "events")


def replayed(rows: DataFrame, folder: str, batches: int, late: str, time: str = "ts", last: str = "1000 days", gap: str = "30 minutes", key: str = "user_id") -> str:
    """``sessions`` of ``rows`` as a stream of ``batches`` files in any order, then of one row far ahead that closes what is open; the folder of the result.

    Each micro-batch writes a folder of its own number, so that one that comes again takes the place of itself.
    """
    spark = rows.sparkSession
    rows.repartition(batches, F.xxhash64(*rows.columns)).write.parquet(f"{folder}/in")
    ahead = rows.agg(F.max(time).alias(time)).select((F.col(time) + F.expr(f"interval {last}")).alias(time))
    ahead.select(*(F.col(time) if c == time else F.lit(-1).cast(t).alias(c) for c, t in rows.dtypes)).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = sessions(stream.withWatermark(time, late), gap, time, key)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    found.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def index_stream(docs: DataFrame, root: str, stream: str, checkpoint: str):
    """Keeps the index under ``root`` up with a stream of documents; returns the writer, to be started.

    A document takes the place of the one of its slug; of several in one micro-batch that with the largest hash of all columns counts,
    so that a batch that comes again says the same.
    """
    from ..operators.engine import IndexEngine

    def put(batch: DataFrame, n: int) -> None:
        plain = [c for c, t in batch.dtypes if "map" not in t]
        last = batch.groupBy("slug").agg(F.max_by(F.struct(*batch.columns), F.xxhash64(*plain)).alias("r")).select("r.*")
        IndexEngine.open(batch.sparkSession, root).add_batch(last, stream, n)

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
