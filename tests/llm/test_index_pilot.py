"""The pilot of the inverted multi-index: what it visits, what it measures, and the exact neighbours it goes by."""

import numpy as np

from folioscope.llm import multiindex, registry


def brute(ids, x, own, k):
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    best = {}
    for i, s in zip(ids, unit @ unit[list(ids).index(own)], strict=True):
        if i != own:
            best[i] = max(best.get(i, -2.0), s)
    return sorted(best, key=lambda i: (-round(best[i], 12), i))[:k]


def table_of(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def test_clusters_are_found_by_visiting_few_entries(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.15
    ids = np.arange(6000)
    got = {}
    rows = multiindex.search(table_of(spark, ids, x).repartition(6), lambda i: i % 50 == 0).collect()
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & set(brute(ids, x, q, 5))) for q in range(0, 6000, 50))
    assert len(got) == 120 and hits / 600 >= 0.9
    told = {(r["visit"], r["recall"]) for r in rows}
    assert len(told) == 1
    visit, recall = told.pop()
    assert visit < 0.3 and recall >= 0.9 and abs(recall - hits / 600) < 0.06


def test_visit_and_recall_of_the_given_table(spark):
    told = registry.queries()["op3_inverted_multi_index"](spark, "/root/testdata/sf0.01").select("visit", "recall").distinct().collect()
    assert len(told) == 1 and 0 < told[0]["visit"] <= 1 and told[0]["recall"] >= 0.88


def test_exact_neighbours_of_pilots(spark):
    """Ties, repeated ids and several partitions; a pilot's own id never counts."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, size=(900, 3)).astype(float) + np.array([0.5, 0, 0])
    ids = np.concatenate([np.arange(600), np.arange(300)])
    entries = table_of(spark, ids, x).selectExpr("vec_id as id", "embedding as vector", "vec_id * 7 as cell").repartition(5)
    pilots = [(int(i), x[i]) for i in range(0, 600, 60)]
    got = {}
    for r in multiindex.exact(pilots, entries, 4).collect():
        assert r["cell"] == r["id"] * 7
        got.setdefault(r["pilot"], []).append((r["id"], r["score"]))
    for p, (own, v) in enumerate(pilots):
        score = {}
        for i, c in zip(ids, multiindex.cosine(v, x), strict=True):
            if i != own:
                score[int(i)] = max(score.get(int(i), -2.0), c)
        want = sorted(score, key=lambda i: (-score[i], i))[:4]
        assert sorted(got[p], key=lambda t: (-t[1], t[0])) == [(i, score[i]) for i in want]


def test_needs_are_those_of_the_traversal():
    rng = np.random.default_rng(2)
    a, b, sizes = rng.random(7), rng.random(6), rng.integers(0, 9, 42)
    sizes[5] = 0
    cells = [int(c) for c in np.flatnonzero(sizes)]
    need = multiindex.needs(a, b, sizes, cells)
    for c, share in zip(cells, need, strict=True):
        held = round(share * sizes.sum())
        assert c in multiindex.traverse(a, b, sizes, held + 1) and c not in multiindex.traverse(a, b, sizes, held)


def test_choice():
    need = np.linspace(0, 0.99, 100)
    visit, recall = multiindex.chosen(need, need, 0.93, 1000)
    assert abs(visit - 0.921) < 1e-9 and recall == 0.93
    assert multiindex.chosen(np.zeros(0), np.zeros(0), 0.93, 10) == (1.0, None)
    visit, recall = multiindex.chosen(np.array([0.2]), np.zeros(0), 0.93, 10)
    assert abs(visit - 0.3) < 1e-9 and recall is None
    assert multiindex.enough(10, 5) == 1 and 0.9 < multiindex.enough(1000, 10**9) < 0.92 < multiindex.enough(1000, 50) < 1


def test_vectors_of_other_lengths_take_no_part(spark):
    """Of lengths held by equally many vectors the larger counts; a table of one id has no pilots to go by."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 0.1, 0.0]), (52, [0.0, 0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in multiindex.search(v, lambda i: i % 50 == 0).orderBy("rank").collect()]
    assert got == [(50, 1, 51), (50, 2, 52)]
    assert multiindex.search(v.where("vec_id = 50"), lambda i: i % 50 == 0).count() == 0
