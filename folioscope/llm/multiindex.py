"""Approximate nearest neighbours by cosine: an inverted multi-index.

Unit vectors are cut into halves, and each half is quantised by its own centroids, so that a cell is a
pair of centroids. A query takes the pairs in order of summed distance, off a heap (Babenko and
Lempitsky, CVPR 2012), until their cells hold ``visit`` times all entries, and the entries of those
cells are ranked again by the cosine of the whole vectors as given, in double precision.

How much has to be visited hangs on the data, so a pilot finds it out: the exact neighbours of ``PILOTS``
vectors, by one pass over all entries, and how many entries come before each of them. Half of the pilots choose
the smallest ``visit`` that finds enough of their neighbours, the other half measure what it finds of theirs. Enough
is ``LEAST`` and ``ERRORS`` standard errors of a share over so many pilots and queries, as few queries stray further.

Bounds. Centroids are fitted on the driver on at most ``SAMPLE`` vectors (those with the smallest
hash), the first ``PILOTS`` of which are the pilots; every vector is indexed. A half has ``CENTROIDS`` centroids, and more as the entries grow, so that a
cell holds some ``HELD`` of them, up to ``MOST``. What is broadcast is the centroids and the number of entries of each
cell, at most ``MOST`` squared. A cell with more than ``HELD`` entries is dealt out in
parts by hash, so a task holds no more than one part (in expectation) and one batch of queries. Each
task gives a query its best ``k`` ids of a part; the last ranking gets no more than that. Queries that end
with fewer than ``k`` ids though there are more (their cells were full of their own rows, or of one id's)
go through all cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import cut, prepare

CENTROIDS = 16
MOST = 1024
SAMPLE = 10_000
ROUNDS = 12
HELD = 2_000
PILOTS = 400
LEAST = 0.9
ERRORS = 2


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centroids by Lloyd's rounds, from points spread evenly over the sample."""
    k = max(1, min(k, len(points)))
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _apart(points, centroids).argmin(1)
        for c in range(k):
            if (own := points[nearest == c]).size:
                centroids[c] = own.mean(0)
    return centroids


def _apart(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, as many as points times centroids."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)[None, :], 0)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance until they hold ``wanted`` entries: a heap of pairs of places
    in the two sorted lists, where a pair comes in when both pairs before it have gone out."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, got, held = [(first[a[0]] + second[b[0]], 0, 0)], set(), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        seen.add((i, j))
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            got.append(cell)
            held += int(sizes[cell])
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in seen):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in seen):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return got


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; exact."""
    _, power = np.frexp(np.abs(vectors).max(1, initial=0.0))
    return np.ldexp(vectors, -power[:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors**2).sum(1))[:, None]


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each from sums over one pair alone, so that a pair's value doesn't hang on its batch."""
    query, vectors = _scaled(query[None])[0], _scaled(vectors)
    dots = (vectors * query).sum(1)
    return dots / (np.sqrt((vectors**2).sum(1)) * np.sqrt((query**2).sum()))


def nearest(query: np.ndarray, own: int, rough: np.ndarray, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ids but ``own``, their scores and rows, each by its best vector. ``ids`` in order, where
    ``starts`` has the first row of each; ``rough``: cosines to within a billionth."""
    best = np.maximum.reduceat(rough, starts)
    best[ids[starts] == own] = -np.inf
    least = np.partition(best, -k)[-k] if len(best) > k else -2.0
    stops = np.append(starts[1:], len(ids))
    near = np.flatnonzero(best >= max(least, -2.0) - 1e-9)
    rows = np.concatenate([np.arange(starts[n], stops[n]) for n in near]) if len(near) else near
    score = cosine(query, vectors[rows])
    order = np.lexsort((ids[rows], -score))
    _, first = np.unique(ids[rows][order], return_index=True)
    taken = order[np.sort(first)][:k]
    return ids[rows][taken], score[taken], rows[taken]


def exact(pilots: list[tuple[int, np.ndarray]], entries: DataFrame, k: int) -> DataFrame:
    """(pilot, id, score, cell): the ``k`` nearest of ``entries`` (id, vector, cell) to each pilot, its own id
    left out; an id by its best vector. Ties go to the smaller id. A task keeps ``k`` rows a pilot."""
    own = np.array([i for i, _ in pilots], np.int64)
    sent = entries.sparkSession.sparkContext.broadcast(np.array([v for _, v in pilots]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[int, tuple[float, int]]] = [{} for _ in own]
        units = _units(sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, cells, vectors = ids[order], cells[order], _matrix(batch.column(1))[order]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            rough = units @ _units(vectors).T
            for p, best in enumerate(kept):
                found, score, rows = nearest(sent.value[p], own[p], rough[p], ids, starts, vectors, k)
                for i, x, c in zip(found.tolist(), score.tolist(), cells[rows].tolist(), strict=True):
                    if i not in best or x > best[i][0]:
                        best[i] = (x, c)
                for i in sorted(best, key=lambda i: (-best[i][0], i))[k:]:
                    del best[i]
        out = [(p, i, x, c) for p, best in enumerate(kept) for i, (x, c) in best.items()]
        if out:
            p, i, x, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(i, pa.int64()), pa.array(x, pa.float64()), pa.array(c, pa.int64())], ["pilot", "id", "score", "cell"])

    found = entries.select("id", "vector", "cell").mapInArrow(scan, "pilot int, id bigint, score double, cell bigint")
    found = found.groupBy("pilot", "id").agg(F.max("score").alias("score"), F.max_by("cell", "score").alias("cell"))
    rank = F.row_number().over(Window.partitionBy("pilot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def needs(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, cells: list[int]) -> np.ndarray:
    """For each cell the share of all entries above which ``visit`` has to be for ``traverse`` to come to it:
    what the cells of smaller summed distance hold."""
    apart = (first[:, None] + second[None, :]).ravel()
    return np.array([sizes[apart < apart[c]].sum() / sizes.sum() for c in cells])


def enough(pilots: int, queries: int) -> float:
    """The share of neighbours, of so many of the pilots', that has to be found for ``LEAST`` of so many of the queries'
    to be found but for a chance of ``ERRORS`` standard errors; at most all."""
    error = np.sqrt(LEAST * (1 - LEAST) * (1 / max(pilots, 1) + 1 / max(queries, 1)))
    return float(min(1.0, LEAST + ERRORS * error))


def chosen(choosing: np.ndarray, measuring: np.ndarray, target: float, every: int) -> tuple[float, float | None]:
    """(visit, recall): the smallest share that comes to ``target`` of the needs that choose, and the share of the others'
    that it comes to. Without needs to choose by: everything, and no recall."""
    if not len(choosing):
        return 1.0, None
    at = np.sort(choosing)[int(np.ceil(target * len(choosing))) - 1]
    visit = min(1.0, (round(float(at) * every) + 1) / every)
    return visit, float((measuring < visit).mean()) if len(measuring) else None


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles) of rows that can take part: an id, and a vector that isn't null or empty,
    holds no null or non-finite component and isn't zero. Vectors have to agree in length: those of
    another than the commonest length (of equals, the larger) take no part."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(sound)


def search(rows: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, visit: float | None = None, centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, visit, recall): the nearest rows of each query that the index finds.

    ``queries``: a condition on the id; each distinct (id, vector) it holds for is a query, and every
    row but those of the query's own id is a candidate. Rows that cannot take part (see ``usable``) are
    neither. Repeated rows of one id and vector count once; of one id with several vectors the nearest
    counts. Ties go to the smaller id. Fewer than ``k`` candidates: all of them. Nothing to search: no
    rows. Columns other than the two are not looked at. ``centroids``: of each half; None: by the number of rows.
    ``visit``: the share of entries to visit; None: as the pilot says. ``recall``: what the pilot measured at that
    share, null without pilots to measure by or with a given ``visit``.
    """
    spark = rows.sparkSession
    prepare(spark)
    fine = usable(rows, id_col, vector_col)
    lengths = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, visit double, recall double")
    if not lengths:
        return empty
    width = lengths[0]["n"]
    fine = fine.where(F.size("vector") == width).distinct()
    drawn = fine.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in drawn], np.float64)
    half = (width + 1) // 2
    units = _units(sample)
    if centroids is None:
        centroids = min(MOST, max(CENTROIDS, int(np.ceil(np.sqrt(fine.count() / HELD)))))
    books = [kmeans(units[:, :half], centroids)]
    books.append(kmeans(units[:, half:], centroids) if width > half else np.zeros((1, 0)))
    n_cells = len(books[0]) * len(books[1])
    sent = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = _units(_matrix(batch.column(1)))
                one, two = (_apart(u[:, s], b).argmin(1) for s, b in zip((slice(half), slice(half, None)), sent.value, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one * len(sent.value[1]) + two)], ["id", "vector", "cell"])

    entries = cut(fine.mapInArrow(assign, "id bigint, vector array<double>, cell bigint"))
    sizes = np.zeros(n_cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most as many rows as cells
        sizes[r["cell"]] = r["count"]
    known = spark.sparkContext.broadcast(sizes)
    every = int(sizes.sum())
    asked = entries.where(queries(F.col("id"))).select("id", "vector")
    recall = None
    if visit is None:
        pilots = [(r["id"], v) for r, v in zip(drawn[:PILOTS], sample, strict=False)]
        near: list[list[int]] = [[] for _ in pilots]
        for r in exact(pilots, entries, k).collect():  # at most k rows a pilot
            near[r["pilot"]].append(r["cell"])
        apart = [_apart(units[: len(pilots), s], b) for s, b in zip((slice(half), slice(half, None)), books, strict=True)]
        need = [needs(a, b, sizes, c) for a, b, c in zip(*apart, near, strict=True)]
        choosing, measuring = np.concatenate(need[::2]), np.concatenate([*need[1::2], np.zeros(0)])
        visit, recall = chosen(choosing, measuring, enough(len(choosing), k * asked.count()), every)
    wanted = max(int(np.ceil(visit * every)), k + 1)
    parts = np.maximum(1, -(-sizes // HELD))
    number = F.get(F.split(F.lit(",".join(map(str, parts.tolist()))), ","), F.col("cell").cast("int")).cast("long")
    dealt = entries.select("cell", F.pmod(F.xxhash64("id"), number).alias("part"), F.lit(0).alias("asks"), "id", "vector")

    def visits(wanted: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number_of = known.value, np.maximum(1, -(-known.value // HELD))
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _units(_matrix(batch.column(1)))
            first, second = (_apart(u[:, s], b) for s, b in zip((slice(half), slice(half, None)), sent.value, strict=True))
            for at in range(0, batch.num_rows, 256):
                rows_, cells, part = [], [], []
                for i in range(at, min(at + 256, batch.num_rows)):
                    for cell in traverse(first[i], second[i], own, wanted):
                        n = int(number_of[cell])
                        rows_ += [i] * n
                        cells += [cell] * n
                        part += range(n)
                took = pa.array(rows_, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(part, pa.int64()), pa.array([1] * len(rows_), pa.int32()), batch.column(0).take(took), batch.column(1).take(took)], ["cell", "part", "asks", "id", "vector"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, units, starts = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, part, asks, own = (batch.column(i).to_numpy() for i in range(4))
            matrix = _matrix(batch.column(4))
            turns = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]))))
            for a, b in zip(turns, [*turns[1:], batch.num_rows], strict=True):
                if (cells[a], part[a]) != key:
                    key, ids, vectors, units = (cells[a], part[a]), [], [], None
                if not asks[a]:
                    ids.append(own[a:b])
                    vectors.append(matrix[a:b])
                    continue
                if not len(ids):
                    continue
                if units is None:
                    ids, vectors = np.concatenate(ids), np.concatenate(vectors)
                    order = np.argsort(ids, kind="stable")
                    ids, vectors = ids[order], vectors[order]
                    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
                    units = _units(vectors)
                rough = _units(matrix[a:b]) @ units.T
                out: list[tuple] = []
                for i in range(b - a):
                    found, score, _ = nearest(matrix[a + i], own[a + i], rough[i], ids, starts, vectors, k)
                    out += [(int(own[a + i]), e, x) for e, x in zip(found.tolist(), score.tolist(), strict=True)]
                q, e, x = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(e, pa.int64()), pa.array(x, pa.float64())], ["query_id", "vec_id", "score"])

    def answers(asked: DataFrame, wanted: int) -> DataFrame:
        sent = asked.mapInArrow(partial(visits, wanted), "cell bigint, part bigint, asks int, id bigint, vector array<double>")
        met = dealt.unionByName(sent).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
        found = met.mapInArrow(best, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        told = F.lit(float(visit)).alias("visit"), F.lit(recall).cast("double").alias("recall")
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *told)

    found = answers(asked, wanted)
    if wanted >= every:
        return found
    found = cut(found)
    others = entries.select("id").distinct().count() - 1
    had = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, others))
    short = cut(asked.join(had, "id", "left_anti"))
    if not others or short.isEmpty():
        return found
    whole = answers(short, every)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(whole)
