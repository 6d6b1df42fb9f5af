"""BM25 with pruned blocks, substrings by trigrams, near spellings: against plain code."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import spelling
from folioscope.operators.relevance import Bm25
from folioscope.operators.substrings import Trigrams

WORDS = re.compile(r"[^\W_]+")


def texts(n, seed=4):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "in"], [f"w{i}" for i in range(300)]
    return [(f"d{i:04d}", None if i % 97 == 0 else "\n".join(" ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randint(0, 30))) for _ in range(2))) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return texts(1500)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('bm25')}"
    made = Bm25.build(spark.createDataFrame(rows, "slug string, text string"), root, "k", block=4)
    assert Bm25.open(spark, root, "other") is None
    assert Bm25.open(spark, root, "k").state == made.state
    return made


def plain(rows, words, k):
    docs = [(s, WORDS.findall((t or "").lower())) for s, t in rows]
    mean = sum(len(w) for _, w in docs) / len(docs)
    weights = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t in words if (n := sum(t in w for _, w in docs))}
    scored = [(-sum(x * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, x in sorted(weights.items())), s) for s, w in docs if weights.keys() & set(w)]
    return [(s, -x) for x, s in sorted(scored)[:k]]


def test_scores_are_those_of_plain_bm25(index, rows):
    for query, k in (("w1 the", 10), ("the of", 5), ("w7 w8 w9 and", 40), ("w3 nothing", 3)):
        got = [(r["rank"], r["slug"], r["score"]) for r in index.top(query, k).orderBy("rank").collect()]
        want = plain(rows, sorted(set(query.split())), k)
        assert [g[0] for g in got] == list(range(1, len(want) + 1)) and len(got) == len(want)
        assert all(abs(g[2] - w[1]) < 1e-9 for g, w in zip(got, want, strict=True)) and {g[1] for g in got[:-3]} <= {w[0] for w in want}
    assert index.top("zzz").count() == 0 and index.top("").count() == 0


def test_blocks_are_skipped(index):
    weights = index.weights(["w1", "w2"])
    least, first = index.threshold(weights, 5, 8)
    needed, every = index.needed(weights, least).count(), index.bounds(weights).count()
    assert len(first) == 8 and least > 0 and needed < every / 2
    bounds = {r["block"]: r["bound"] for r in index.bounds(weights).collect()}
    own = index.scored(weights, index.bounds(weights)).withColumn("block", F.pmod(F.xxhash64("slug"), F.lit(index.state["blocks"]))).collect()
    assert all(r["score"] <= bounds[r["block"]] * (1 + 1e-9) for r in own)


def test_substrings(spark, rows, tmp_path):
    odd = [("e0", ""), ("e1", None), ("e2", "aaaa aaa"), ("e3", "Ünï😀code x" + "y" * 30_000), ("e4", "ab"), ("e5", "line\nbreak 100%_")]
    index = Trigrams.build(spark.createDataFrame(rows + odd, "slug string, text string"), f"file://{tmp_path}/grams", "k", folder=100)
    for wanted in ("the of the", "w1 w", "aaa", "ï😀c", "e\nb", "%_", "zzzz", "a", "", "AA a", "y" * 40, " w29"):
        got = sorted(tuple(r) for r in index.holding(wanted).collect())
        low = wanted.lower()
        assert got == sorted((s, t.lower().count(low), t.lower().index(low) + 1) for s, t in rows + odd if t and low and low in t.lower()), wanted
    read = {f.split("shard=")[1].split("/")[0] for f in index.holding("y" * 40).inputFiles() if "/texts/" in f}
    assert len(read) == 1  # of fifteen folders of texts


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_near_words_against_brute_force(spark):
    rng = random.Random(2)
    stems = ["", "a", "ab", "ça", "漢字", "😀b", "letter", "x" * 19, "y" * 22, "abcdefghijklmnopqrstuvwxyz", "z" * 300]
    words = set(stems)
    for _ in range(160):
        w = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            kind, at = rng.random(), rng.randint(0, len(w))
            w[at : at + (kind < 0.6)] = [] if kind < 0.3 else [rng.choice("abxyzç")]
        words.add("".join(w))
    words = sorted(words)
    rows = [(w,) for w in words]
    for d in (1, 2):
        got = {tuple(r) for r in spelling.neighbours(spark.createDataFrame([*rows, (None,), ("ab",)], "word string"), spark.createDataFrame([*rows, (None,)], "token string"), d).collect()}
        assert got == {(a, b, n) for a in words for b in words if abs(len(a) - len(b)) <= d and (n := distance(a, b)) <= d}
    none = spark.createDataFrame([], "word string")
    assert spelling.neighbours(none, none.withColumnRenamed("word", "token")).count() == 0
