"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are hashed into ``DIMENSION`` places: each distinct word of its whole text and
the word's beginnings, and marks of its form (shares of capitals, of symbols, of repeated neighbours, of distinct words,
in steps). One weight a place, shared by all grades and never above zero (a text can only lose by what
it holds, so that length is no merit), gives a score s; ordered thresholds
t0 < t1 < ... give P(grade <= k) = sigmoid(t_k - s). From these come the expected grade and the tail
probability P(grade >= k) by which documents are selected.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows, those with the smallest MD5 of
their id, of which the driver gets hashed features and no texts. Scoring is a pass over all rows
without a shuffle; what is broadcast is the weights, whose number is fixed.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import words
from .support import ASCII_UPPER, prepare

DIMENSION = 1 << 18
SAMPLE = 12_000
SEEN = 5  # a place counts if so many rows of the sample have it
GRADES = 3
STEPS = 100
START = 0.03
PENALTY = 3e-5
PULL = 2.0  # what a row below the highest grade counts in fitting
STEMS = (4, 5)  # bytes of the beginnings of words
SMOOTH = 12  # words without any mark that each text is thought to have besides its own
MARK = 3  # places that a mark has, so that it outweighs single words
KEPT = 500_000
UPPER = ASCII_UPPER.encode()
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
TRAILING = re.compile(rb"[!-/:-@\[-`{-~]{2}(?![^\s])")
LOUD = re.compile(rb"(?<![^\s])[A-Z]{2,}")


def place(token: bytes) -> int:
    return xxhash.xxh32_intdigest(token) % DIMENSION


def places(token: bytes) -> list[int]:
    """Where a token counts: a mark in one place, a word also where its first bytes have theirs."""
    if token[:1] == b" ":
        return [place(token)]
    return [place(token), *(place(b"%d " % n + token[:n]) for n in STEMS if len(token) > n)]


def tokens(text: str | None) -> set[bytes]:
    """Distinct words, and marks (which no word equals, since they begin with a blank)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    said = words(text)
    found = set(said)
    # a short text has to show more than a long one before its form is marked
    n, m = len(raw) + SMOOTH * 8, len(said) + SMOOTH
    shares = {
        "capitals": (len(raw) - len(raw.translate(None, UPPER))) / n,
        "symbols": (len(raw) - len(raw.translate(None, SYMBOLS))) / n,
        "trailing": len(TRAILING.findall(raw)) / m,
        "loud": len(LOUD.findall(raw)) / m,
        "again": sum(map(eq, said, said[1:])) / m,
    }
    different, marks = len(found), []
    for name, share in shares.items():
        marks += [f" {name} {step}" for step in (0.02, 0.05, 0.1, 0.2, 0.4, 0.7) if share >= step]
    marks += [f" few {step}" for step in (5, 2.5, 1, 0.5) if said and different / math.sqrt(len(said)) < step]
    if not said:
        marks.append(" none")
    found.update(f"{m} {copy}".encode() for m in marks for copy in range(MARK))
    return found


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): a point for high quality and a point for not being toxic, so 0, 1 or 2.

    Rows that lack a rating, or have one other than 0 and 1, have no grade. An id with several
    grades takes the lowest.
    """
    grade = F.when(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1), F.col("quality") + 1 - F.col("toxic"))
    rows = labels.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).dropna()
    return rows.groupBy("id").agg(F.min("grade").alias("grade"))


class Model:
    """Weights and thresholds. ``thresholds`` has one entry less than there are grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights.astype(np.float32), [float(t) for t in thresholds]
        self._known: dict[bytes, float] = {}

    def score(self, text: str | None) -> float:
        known, found = self._known, []
        for t in tokens(text):
            if (w := known.get(t)) is None:
                w = math.fsum(self.weights[places(t)].tolist())
                if len(known) < KEPT:
                    known[t] = w
            found.append(w)
        return math.fsum(found)  # exact, so that the order of the words doesn't count

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _descend(loss, x: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, back = slope.copy(), []
        for s, d in reversed(moves):
            share = (s @ way) / (s @ d)
            back.append(share)
            way -= share * d
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.abs(slope).sum()))
        for (s, d), share in zip(moves, reversed(back), strict=True):
            way += (share - (d @ way) / (s @ d)) * s
        length, fall = 1.0, float(slope @ way)
        while length > 1e-8:
            then, turned = loss(x - length * way)
            if then <= value - 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        s, d = -length * way, turned - slope
        if s @ d > 1e-12:
            moves = [*moves[1 - memory :], (s, d)]
        gain, x, value, slope = value - then, x + s, then, turned
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return x


def fit_rows(rows: list[np.ndarray], grades: list[int], n_grades: int = GRADES) -> Model:
    """Fits by descent on the whole sample; ``rows`` is used up. No rows: weights of 0 and thresholds at which every row has the highest grade."""
    if not rows:
        return Model(np.zeros(DIMENSION), np.linspace(-6, -4, n_grades - 1))
    y = np.array(grades)
    pull = np.where(y < n_grades - 1, PULL, 1.0)
    at = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    n_rows = len(rows)
    rows.clear()  # its places are in ``at``
    seen = np.bincount(at, minlength=DIMENSION)
    common = seen >= min(SEEN, n_rows)
    used = np.flatnonzero(common)
    held = common[at]
    of, at = of[held], (np.cumsum(common, dtype=np.int32) - 1)[at[held]]
    del held
    begins = np.searchsorted(of, np.arange(n_rows))
    filled = np.diff(np.append(begins, len(of))) > 0
    across = of[np.argsort(at, kind="stable")]
    heads = np.cumsum(seen[used]) - seen[used]
    del of
    below = np.clip([(y <= k).mean() for k in range(n_grades - 1)], 0.01, 0.99)
    start = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    every = np.concatenate((np.full(len(used), START), start[:1], gaps))
    cut_at = lambda p: np.cumsum(np.concatenate((p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :]))))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        roots, thresholds = p[: len(used)], cut_at(p)
        weights = -(roots**2)
        s = np.zeros(n_rows)
        if len(at):
            s[filled] = np.add.reduceat(weights.astype(np.float32)[at], begins[filled], dtype=np.float64)
        edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
        high, low = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
        high[y == n_grades - 1], low[y == 0] = 1.0, 0.0
        chance = np.maximum(high - low, 1e-12)
        dh, dl = pull * high * (1 - high) / chance, pull * low * (1 - low) / chance
        dt = np.array([(dl[y == k + 1].sum() - dh[y == k].sum()) / n_rows for k in range(n_grades - 1)])
        dgap = [dt[k:].sum() * math.exp(p[len(used) + k]) for k in range(1, n_grades - 1)]
        pulls = np.add.reduceat(((dh - dl) / n_rows).astype(np.float32)[across], heads, dtype=np.float64) if len(at) else roots
        dw = (pulls * -2 + PENALTY) * roots
        value = -(pull * np.log(chance)).sum() / n_rows + PENALTY / 2 * float(roots @ roots)
        return value, np.concatenate((dw, [dt.sum()], dgap))

    every = _descend(loss, every)
    full = np.zeros(DIMENSION)
    full[used] = -(every[: len(used)] ** 2)
    return Model(full, cut_at(every))


def packed(found: list[int]) -> bytes:
    """Places in order, as compressed differences: what the driver gets of a text."""
    return zlib.compress(np.diff(np.sort(np.array(found, np.int32)), prepend=np.int32(0)).astype(np.int32).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.int32), dtype=np.int32)


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on documents that ``grades(id, grade)`` rates, at most ``sample`` of them: labels without a document
    are left out before any is taken. Documents of one id and different texts count each; null texts are
    empty ones; null ids have no grade. If no document has a grade, the model keeps every document, and a warning says so."""
    prepare(docs.sparkSession)
    grades = grades.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = grades.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample).select(F.col("id").alias("__id"), F.col("grade").alias("__grade"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("id", "__grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed([p for t in tokens(x.as_py()) for p in places(t)]) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "grade", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, grade int, places binary").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "places").limit(sample).collect()
    if not got:
        warnings.warn("no document has a grade: the classifier keeps every document", stacklevel=2)
    places_of, grades_of = [unpacked(r["places"]) for r in got], [r["grade"] for r in got]
    del got
    return fit_rows(places_of, grades_of)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, score, expected_grade, p_top (P of the highest grade), keep (p_top >= least).

    Null texts score as empty ones. Ids are passed on, null and repeated ones too; other columns are
    not looked at. No rows: no rows.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*map(np.asarray, sent.value))
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            tails = [own.tails(s) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([math.fsum(t) for t in tails], pa.float64()), pa.array([t[-1] for t in tails], pa.float64()), pa.array([t[-1] >= least for t in tails], pa.bool_())], ["id", "score", "expected_grade", "p_top", "keep"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, expected_grade double, p_top double, keep boolean")


def kept(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, columns as they were, whatever their names.

    Each row is judged by its own text: null texts as empty ones, repeated rows alike. No rows: no rows.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*map(np.asarray, sent.value))
        for batch in batches:
            yield batch.filter(pa.array([own.tails(own.score(t.as_py()))[-1] >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
