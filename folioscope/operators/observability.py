"""Request counters, latency histograms and rate limits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import importable

# Upper bounds of the latency buckets, seconds.
BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
LIMIT, WINDOW_S = 60, 60


def request_counts(requests: DataFrame) -> DataFrame:
    """(status, requests, errors) of ``requests(status)``."""
    return requests.groupBy("status").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))


def latency_histogram(requests: DataFrame, seconds: str = "seconds") -> DataFrame:
    """(bound, requests): how many took no longer, for each bound and for all ("+Inf"); one pass."""
    sums = requests.agg(*(F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)), F.count(seconds).alias("all"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("bound"), F.col(f"b{i}").alias("requests")) for i, b in enumerate(BOUNDS)), F.struct(F.lit("+Inf").alias("bound"), F.col("all").alias("requests")))
    return sums.select(F.explode(rows).alias("r")).select("r.bound", "r.requests")


def recent_requests(requests: DataFrame, client: str = "client", micros: str = "micros", window_s: int = WINDOW_S) -> DataFrame:
    """How many requests of its client each request sees in the window up to itself, itself included: at
    least as many as a limiter that forgets rejected ones would."""
    span = Window.partitionBy(client).orderBy(micros).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return requests.withColumn("recent", F.count("*").over(span))


class Limiter:
    """A sliding window of one client: times of the requests that were let through."""

    def __init__(self, times: list[int] | None = None, limit: int = LIMIT, window_s: int = WINDOW_S) -> None:
        self.times, self.limit, self.window = list(times or []), limit, window_s * 1_000_000

    def ask(self, at: int) -> tuple[bool, int]:
        """(allowed, seconds to wait): rejected requests aren't kept."""
        self.times = [t for t in self.times if at - t < self.window]
        if len(self.times) < self.limit:
            self.times.append(at)
            return True, 0
        return False, math.ceil((self.times[0] + self.window - at) / 1_000_000)


def rate_limit(requests: DataFrame, client: str = "client", micros: str = "micros", request_id: str = "id", limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """(id, client, micros, allowed, retry_after) of each request, exactly.

    A client's requests depend on each other, so they are one ordered stream; the task reads it batch by
    batch and holds no more than ``limit`` times of one client at once.
    """
    import pyarrow as pa

    importable(requests.sparkSession)
    rows = requests.select(F.col(request_id).alias("id"), F.col(client).cast("string").alias("client"), F.col(micros).cast("long").alias("micros"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        own, state = None, None
        for batch in batches:
            out, wait = [], []
            for c, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or c != own:
                    own, state = c, Limiter(None, limit, window_s)
                ok, after = state.ask(at)
                out.append(ok)
                wait.append(after)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_()), pa.array(wait, pa.int64())], ["id", "client", "micros", "allowed", "retry_after"])

    return rows.repartition("client").sortWithinPartitions("client", "micros", "id").mapInArrow(run, f"id {kind}, client string, micros bigint, allowed boolean, retry_after bigint")
