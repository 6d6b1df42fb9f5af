"""Operator 9 against plain code: scores of every document, and a fit that nothing near it beats."""

import math
import random

import numpy as np
import pytest

from folioscope.llm import quality
from folioscope.llm.q_quality import QUERIES

DATA = "/root/testdata/sf0.001"


def test_query_against_brute_force(spark):
    """Each document's places are laid out as a row of a dense table, times all weights, without the model's own sums."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{DATA}/labels.parquet")))
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        dense = np.zeros(quality.DIMENSION)
        for token in quality.tokens(r["text"]):
            for place in quality.places(token):
                dense[place] += 1
        score = float(dense @ model.weights.astype(np.float64))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        want[r["doc_id"]] = (score, sum(tails), tails[-1])
    (query,) = QUERIES.values()
    got = query(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        score, expected, top = want[r["doc_id"]]
        assert r["expected_grade"] == pytest.approx(expected, abs=1e-6) and r["p_top"] == pytest.approx(top, abs=1e-6)
        assert r["keep"] == (top >= 0.5) or abs(top - 0.5) < 1e-6


def sample(n, seed=3):
    rng = random.Random(seed)
    rows, grades = [], []
    for _ in range(n):
        bad = rng.choice([0, 0, 1, 2, 4])
        rows.append(sorted([7] * min(1, bad) + [9] * (bad > 1) + rng.sample(range(100, 140), 6)))
        grades.append(2 - min(2, bad) if rng.random() < 0.9 else rng.randint(0, 2))
    return rows, grades


def objective(rows, grades, weights, thresholds):
    """The weighted cumulative-link loss, row by row, with the penalty on the weights' size."""
    total = 0.0
    for places, y in zip(rows, grades, strict=True):
        score = sum(weights[p] for p in places)
        upto = lambda k: 0.0 if k < 0 else 1.0 if k >= len(thresholds) else 1 / (1 + math.exp(-(thresholds[k] - score)))
        total -= (quality.PULL if y < len(thresholds) else 1.0) * math.log(max(upto(y) - upto(y - 1), 1e-12))
    return total / len(rows) + quality.PENALTY / 2 * sum(abs(w) for w in weights.values())


def test_fit_is_not_beaten_nearby():
    rows, grades = sample(400)
    model = quality.fit_rows([np.array(r, np.int32) for r in rows], list(grades))
    used = sorted({p for r in rows for p in r})
    weights = {p: float(model.weights[p]) for p in used}
    best = objective(rows, grades, weights, model.thresholds)
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([0.003, 0.03, 0.3])
        # weights are at most zero by choice: words can only speak against a text
        other = {p: min(0.0, w + rng.gauss(0, size)) for p, w in weights.items()} if rng.random() < 0.5 else dict(weights)
        for p in rng.sample(used, 3):
            other[p] = min(0.0, other[p] + rng.gauss(0, size))
        moved = sorted(t + rng.gauss(0, size) for t in model.thresholds)
        assert objective(rows, grades, other, moved) > best - 2e-4
    assert weights[7] < -0.5 and weights[9] < -0.5 and best < objective(rows, grades, dict.fromkeys(used, 0.0), [-1.0, 0.0])
