"""Joins of overlapping intervals without comparing all pairs.

Two closed intervals overlap if one begins inside the other, and each pair does so in just one of two ways: the right one begins in the
left, or the left one begins in the right after its start. Both are joins of points and intervals. An interval is cut into
dyadic blocks, at most two of each size, that cover it once; a point lies in one block of each size. So blocks are joined by equality: every
match is a result and is met once, however long the intervals are.

Sums by pairs of keys (``shared``) shuffle no pair: keys are dealt into blocks that fit a task, every two blocks meet in one task, and so all
that two keys have in common is summed where it is found, some pairs at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..workers import importable

LEVELS = 62
FEW, MANY = 50_000, 1_000_000  # intervals in a block: at least, where there are more blocks than keep the cores busy, and at most
PAIRS = 1_000_000  # of intervals that are looked at together
ROWS = 100_000  # in a batch that a task gives


def blocks(start: Column, end: Column) -> Column:
    """The dyadic blocks (level, at) that make up [start, end], of integers from 0 on."""
    stop = end + 1

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        low, high = F.call_function("div", start + size - 1, size), F.call_function("div", stop, size)
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("at")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("at")))
        return F.array(left, right)

    top = F.least(F.lit(LEVELS - 1), F.ceil(F.log2((stop - start + 1).cast("double"))).cast("int") + 1)
    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), at))))


def _inside(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of ``points(g, at, p)`` and ``spans(g, low, high, s)`` with low <= at <= high, each once."""
    cut = spans.where("low <= high").select("g", "s", F.explode(blocks(F.col("low"), F.col("high"))).alias("b")).select("g", "s", "b.level", "b.at")
    levels = sorted(r[0] for r in cut.select("level").distinct().collect())  # LEVELS numbers at most
    if not levels:
        return points.limit(0).join(spans.limit(0), "g").select("p", "s")
    keys = F.array(*(F.struct(F.lit(k).cast("int").alias("level"), F.shiftright("at", k).alias("block")) for k in levels))
    in_blocks = points.select("g", "p", F.explode(keys).alias("b")).select("g", "p", "b.level", F.col("b.block").alias("at"))
    # Spark knows neither side's size, as both come of explodes, and would send a row for each point and level through the driver.
    return in_blocks.join(cut.hint("merge"), ["g", "level", "at"]).select("p", "s")


def overlapping(left: DataFrame, right: DataFrame, start: str = "start", end: str = "end", group: str | None = None) -> DataFrame:
    """(left, right): rows of both sides, as structs, whose closed intervals of integers from 0 on overlap, in the same ``group`` if one is named.

    Rows with a null start, end or group, and intervals that end before they start, overlap nothing; repeated rows are rows of their own.
    """
    g = F.col(group) if group else F.lit(0)
    side = lambda rows: rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), g.alias("g"), F.col(start).cast("bigint").alias("low"), F.col(end).cast("bigint").alias("high")).where("low is not null and high >= low and g is not null")
    one, two = side(left), side(right)
    begins = _inside(two.select("g", F.col("low").alias("at"), F.col("row").alias("p")), one.select("g", "low", "high", F.col("row").alias("s")))
    holds = _inside(one.select("g", F.col("low").alias("at"), F.col("row").alias("p")), two.select("g", (F.col("low") + 1).alias("low"), "high", F.col("row").alias("s")))
    return begins.select(F.col("s").alias("left"), F.col("p").alias("right")).unionByName(holds.select(F.col("p").alias("left"), F.col("s").alias("right")))


def _expanded(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the places low[i] to low[i] + n[i] - 1: (i, place)."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) + (low - (np.cumsum(n) - n))[which]


def _summed(code: np.ndarray, n: np.ndarray | None, total: np.ndarray) -> list[np.ndarray]:
    """(code, n, total) of each code once, in order; n is 1 where none is given."""
    places, bits = np.arange(len(code)), len(code).bit_length()
    if int(code.max(initial=0)).bit_length() + bits < 63:  # one sort of both is faster
        both = np.sort(code << bits | places)
        code, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(code)
        code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    if not len(first):
        return [code, code, code]
    many = np.diff(first, append=len(code)) if n is None else np.add.reduceat(n[order], first)
    return [code[first], many, np.add.reduceat(total[order], first)]


def _met(left: np.ndarray, right: np.ndarray, same: bool, most: int) -> Iterator[list[np.ndarray]]:
    """(one, two, n, total) of keys of two blocks, rows key, low and high in columns by low; if both are the same block, of keys one < two.

    Intervals of ``left`` are taken by key, as many as have ``most`` pairs, whole keys if they can be; sums of a key that goes on are carried over.
    """
    left = left[:, np.argsort(left[0], kind="stable")]
    keys, at = np.unique(left[0], return_inverse=True)
    others, other = np.unique(right[0], return_inverse=True)
    width = len(others).bit_length()
    low, high = right[1], right[2]
    n = np.searchsorted(low, left[2], "right") - np.searchsorted(np.sort(high), left[1], "left")
    wide = np.flatnonzero(high > low)  # in others nothing begins after their start
    done, ends, begins = 0, np.cumsum(n), np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
    carried = [np.zeros(0, "int64")] * 3
    while done < len(n):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, "right")))
        edge = int(begins[np.searchsorted(begins, upto, "right") - 1])
        upto = edge if edge > done else upto
        part = np.arange(done, upto)[np.argsort(left[1, done:upto], kind="stable")]
        starts, stops, mine = left[1, part], left[2, part], at[part] << width
        begin = np.searchsorted(low, starts, "left")
        x, y = _expanded(begin, np.searchsorted(low, stops, "right") - begin)
        begin = np.searchsorted(starts, low[wide], "right")
        z, w = _expanded(begin, np.searchsorted(starts, high[wide], "right") - begin)
        z = wide[z]
        code = np.concatenate([mine[x] | other[y], mine[w] | other[z]])
        both = np.concatenate([np.minimum(stops[x], high[y]) - low[y], np.minimum(stops[w], high[z]) - starts[w]])
        if same:
            kept = keys[code >> width] < others[code & ((1 << width) - 1)]
            code, both = code[kept], both[kept]
        if len(carried[0]):
            found = _summed(np.concatenate([carried[0], code]), np.concatenate([carried[1], np.ones(len(code), "int64")]), np.concatenate([carried[2], both]))
        else:
            found = _summed(code, None, both)
        whole = np.searchsorted(found[0], at[upto] << width) if upto < len(n) else len(found[0])
        carried = [c[whole:] for c in found]
        a, b = keys[found[0][:whole] >> width], others[found[0][:whole] & ((1 << width) - 1)]
        yield [np.minimum(a, b), np.maximum(a, b), found[1][:whole], found[2][:whole]]
        done = upto


def shared(rows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(one, two, n, total) of integer keys one < two: how many pairs of their closed intervals overlap, and for how long together, if any do.

    A key's intervals have to fit a task, all pairs don't. Rows with a null, and intervals that end before they start, overlap nothing.
    """
    spark = rows.sparkSession
    importable(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(storage.shared_folder(spark))
    rows = rows.select(F.col(key).cast("bigint").alias("key"), F.col(start).cast("bigint").alias("low"), F.col(end).cast("bigint").alias("high")).where("key is not null and low is not null and high >= low")
    n, most, batch = rows.count(), PAIRS, ROWS
    busy = math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism))  # three meetings of blocks for each core
    blocks = max(1 + n // MANY, min(1 + n // FEW, busy))

    def pack(own: pa.Table) -> pa.Table:
        own = own.sort_by("low")
        values = np.stack([own[c].to_numpy() for c in ("key", "low", "high")]).astype("int64")
        return pa.table({"block": own["block"][:1].cast("int32"), "intervals": pa.array([values.tobytes()], "binary")})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                left, right = (np.frombuffer(rows[c][i].as_buffer(), "int64").reshape(3, -1) for c in ("left", "right"))
                for found in _met(left, right, rows["one"][i].as_py() == rows["two"][i].as_py(), most):
                    for k in range(0, len(found[0]), batch):
                        yield pa.record_batch([pa.array(c[k : k + batch]) for c in found], ["one", "two", "n", "total"])

    # Blocks are kept, and every task reads the two that it needs: nothing is written for a pair of blocks.
    packed = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, intervals binary").checkpoint()
    packed = packed.repartitionByRange(blocks, "block")
    one, two = packed.toDF("one", "left").hint("shuffle_replicate_nl"), packed.toDF("two", "right")
    return one.join(two, F.col("one") <= F.col("two")).mapInArrow(meet, "one bigint, two bigint, n bigint, total bigint")
