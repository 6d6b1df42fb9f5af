"""The other operators against brute force, libraries, SQL or held-out labels."""

import glob
import gzip
import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import decontam, mixing, multiindex, quality, registry, sharding, simhash, tokencount, urlfilter, warc

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, lang string, id long, size int, slot int, weight double, shard string, items string, n_words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, 3, 4.0, "x", "y", 5) for i, t, s in rows], SCHEMA)


def odd(spark):
    """Nulls, blanks, long texts, ties and repeated rows, with columns of the operators' own names."""
    rows = [(0, None, "s1"), (None, "null id", "s1"), (2, "", None), (3, " \n", "s2"), (4, "tie tie", "s2"), (4, "tie tie", "s2"), (5, "w " * 50_000, None), (6, "x" * 50_000, "s3"), (7, "ÀÉ ŭ", "s3")]
    return frame(spark, rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = registry.queries()[name](spark, DATA)
    order = sorted(got.columns)
    want = c.execute(f"select {', '.join(f'{chr(34)}{x}{chr(34)}' for x in order)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*order).collect())


def test_registry():
    names = registry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


# 1
def test_dated_lists(spark):
    e = spark.createDataFrame([("bad.org", "add", 10), ("bad.org", "remove", 20), ("bad.org", "add", 30), ("sub.ok.org", "add", 5), ("ok.org/ads", "add", 1), ("tie.org", "add", 7), ("tie.org", "remove", 7), (None, "add", 1), ("x.org", "mark", 1), ("bad.org", "add", 10)], "pattern string, action string, at int")
    rows = [(1, "http://bad.org/x", 9), (2, "http://m.BAD.org:80/", 10), (3, "https://u:p@bad.org?q", 20), (4, "http://bad.org", 31), (5, "http://ok.org/a", 9), (6, "http://ok.org/Ads/1", 9), (7, "http://sub.ok.org/ads", 9), (8, None, 9), (9, "nonsense", 9), (10, "http://bad.org", None), (11, "http://tie.org", 7), (12, "http://notbad.org", 15)]
    captures = spark.createDataFrame([(i, u, t, "h", True) for i, u, t in rows], "page_id int, url string, fetched_at int, host string, blocked boolean")
    got = {r["page_id"]: r for r in urlfilter.judge(captures, e).collect()}
    assert sorted(i for i, r in got.items() if r["blocked"]) == [2, 4, 6, 7, 11]
    assert (got[2]["pattern"], got[2]["listed_from"], got[4]["listed_from"], got[6]["pattern"]) == ("bad.org", 10, 30, "ok.org/ads")
    assert urlfilter.allowed(captures, e).count() == 7 and urlfilter.allowed(captures, e).columns == captures.columns
    assert urlfilter.judge(captures, e.limit(0)).where("blocked").count() == 0 and urlfilter.judge(captures.limit(0), e).count() == 0


def test_odd_addresses_and_deep_paths(spark):
    e = spark.createDataFrame([("f.org", "add", 1), ("[::1]", "add", 1), ("e.org/a/b", "add", 1), ("e.org/c", "add", 1), ("e.org/c", "remove", 3), ("0.1", "add", 1)], "pattern string, action string, at int")
    rows = [(1, "http://f.org./x", 2), (2, "http://[::1]:80/", 2), (3, "http://e.org/A/b/c", 2), (4, "http://e.org/a", 2), (5, "http://e.org/c/d?x", 2), (6, "http://e.org/c", 3), (7, "http://10.0.0.1/", 2), (8, "http://.../", 2), (9, "http://e.org//a//b", 2)]
    captures = spark.createDataFrame(rows, "page_id int, url string, fetched_at int").selectExpr("*", "1 as __site", "2 as row", "3 as at", "4 as n")
    got = urlfilter.judge(captures, e)
    assert sorted(r["page_id"] for r in got.where("blocked").collect()) == [1, 2, 3, 5, 9]
    assert urlfilter.allowed(captures, e).columns == captures.columns and got.columns[: len(captures.columns)] == captures.columns


def test_long_history_of_a_hot_pattern(spark):
    """As of every time, against the log read one entry after another."""
    rng = random.Random(3)
    log = [("hot.org", rng.choice(["add", "remove"]), t) for t in range(0, 900, 3)] + [(f"x{i}.org", "add", i) for i in range(40)]
    rows = [(i, rng.choice(["http://a.hot.org/p", "http://hot.org", f"http://x{i % 50}.org"]), rng.randint(0, 1000)) for i in range(2000)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id int, url string, fetched_at int").repartition(7), spark.createDataFrame(log, "pattern string, action string, at int")).collect()
    want = {}
    for i, u, t in rows:
        name = "hot.org" if "hot" in u else u[7:]
        last = max(((at, action == "add") for p, action, at in log if p == name and at <= t), default=(0, False))
        want[i] = (last[1], last[0] if last[1] else None)
    assert {r["page_id"]: (r["blocked"], r["listed_from"]) for r in got} == want


# 2
def water(sizes, weights, cap=3):
    """Targets by resharing the excess round by round."""
    target, stopped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in stopped)
        free = [s for s in sizes if s not in stopped]
        total = sum(weights[s] for s in free)
        target = {s: cap * sizes[s] if s in stopped else rest * weights[s] / total for s in sizes}
        more = {s for s in free if target[s] > cap * sizes[s]}
        if not more:
            return target
        stopped |= more


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 30):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 100, 1000, 100_000]) + i for i in range(n)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        want = water(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 1000 and all(r["taken"] <= 3 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 6 * mixing.BLOCK
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    shares = mixing.targets(mixing.sized(docs))
    slots = mixing.schedule(shares).orderBy("slot").limit(2000).collect()  # any stretch is near the weights
    share = {r["source"]: r["hi"] - r["lo"] for r in shares.collect()}
    assert all(abs(sum(x["source"] == s for x in slots) - 2000 * p) < 12 for s, p in share.items())


def test_mix_of_odd_rows(spark):
    docs = odd(spark)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 9 and {r["size"] for r in rows if r["id"] in (0, 2, 3)} == {0} and all(r["taken"] <= 3 * r["size"] for r in rows)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.where("text is null").count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.repeated(docs.limit(0)).count() == 0
    assert all(r["target"] == 0 for r in mixing.mixed(docs.where("doc_id in (0, 2)")).collect())


def test_columns_named_like_helpers(spark):
    """Extra columns of any name come out as they went in, and which of equal rows is repeated stays the same."""
    rows = [(i % 3, f"text {'w ' * 40}{i}", "s", i) for i in range(12)] + [(9, "one more " * 30, None, 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __n int").selectExpr("*", "__n as __id", "__n as __slot", "__n as row", "__n as times", "__n as of", "__n as digest", "__n as __copy")
    for out in (mixing.repeated(docs), sharding.placed(docs).drop("slot", "shard_id", "shard"), simhash.keep_one(docs), decontam.clean(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))):
        assert out.columns == docs.columns and all(r["__n"] == r["__id"] == r["__slot"] == r["row"] == r["digest"] for r in out.collect())
    again = [sorted(r["__n"] for r in mixing.repeated(docs.repartition(n)).collect()) for n in (1, 5)]
    assert again[0] == again[1]


def test_mix_of_small_sources(spark):
    """Sources of less than a block, or few blocks, beside a large one come near their targets, too."""
    docs = [(i, "w " * 3000, "large") for i in range(20)] + [(100 + i, "w " * (5 + i % 90), f"s{i // 4:03d}") for i in range(400)]
    for rows in (docs, docs[20:], [(i, "w " * 10, f"t{i}") for i in range(5)]):
        found = mixing.mixed(frame(spark, rows)).collect()
        for s in {r["source"] for r in found}:
            own = [r for r in found if r["source"] == s]
            limit = 6 * mixing.BLOCK if s == "large" else 0.5
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= limit and all(r["times"] <= 3 for r in own), s
    shares = mixing.targets(mixing.sized(frame(spark, docs)))
    slots = mixing.schedule(shares).where("source <> 'large'").groupBy("source", "part").count().collect()
    laid = {}
    for r in slots:
        laid[r["source"]] = laid.get(r["source"], 0) + r["count"]
    target = {r["source"]: r["target"] for r in shares.collect()}
    assert len(laid) == 100 and all(abs(n - target[s]) <= 0.5 for s, n in laid.items())


def test_schedule_at_any_slot(spark):
    """Points are exact, distinct and even at slots far beyond what doubles can tell apart."""
    for start in (0, 10**9, 10**11, 250_000_000_000, 10**15):
        x = [r[0] for r in spark.range(start, start + 100_000).select(mixing.point(F.col("id"))).collect()]
        assert x == [i * mixing.STEP % (1 << mixing.BITS) for i in range(start, start + 100_000)]
        assert len(set(x)) == 100_000 and all(abs(sum(a <= v / (1 << mixing.BITS) < b for v in x) - 100_000 * (b - a)) < 6 for a, b in ((0, 0.1), (0.37, 0.371), (0.99999, 1)))


def test_mix_against_sql_at_all_sizes(spark):
    """Sources of 1 to 70,000 words, some empty, by the query's own SQL."""
    from folioscope.llm.q_mixing import SQL

    rng = random.Random(9)
    docs = [(i, f"s{i:03d}", n) for i, n in enumerate([1, 2, 10, 63, 64, 65, 1023, 1024, 1025, 2048, 10_000, 70_000, 0, *(rng.randint(1, 10_000) for _ in range(60))])]
    rows = [(k * 1000 + j, "w " * min(700, n - j * 700), s if k else None) for k, s, n in docs for j in range(max(1, -(-n // 700)))]
    found = mixing.mixed(frame(spark, rows)).collect()
    for s in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == s]
        block = own[0]["source_size"] / max(1, min(own[0]["source_size"], 1024), -(-own[0]["source_size"] // 64))
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= block / 2 + 1 and all(r["taken"] <= 3 * r["size"] for r in own), s
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    want = c.execute(f"select doc_id, size, source_size, target, taken, times from ({SQL['op2_mix_sources']})").fetchall()
    assert sorted(want) == sorted((r["id"], r["size"], r["source_size"], r["target"], r["taken"], r["times"]) for r in found)


# 3
def test_recall(spark):
    for name in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
        got = registry.queries()["op3_inverted_multi_index"](spark, f"/root/testdata/{name}").collect()
        data = rows.orderBy("vec_id").collect()
        ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], np.float64)
        norm = np.sqrt((x**2).sum(1))
        found, known = {}, {i: k for k, i in enumerate(ids)}
        for r in got:
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = total = 0
        for q in ids[ids % 50 == 0]:
            s = x @ x[known[q]] / (norm * norm[known[q]])
            s[known[q]] = -9
            want = set(ids[np.lexsort((ids, -s))[:5]])
            mine = sorted(found[q])
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - s[known[m[1]]]) < 1e-12 for m in mine)
            hits, total = hits + len(want & {m[1] for m in mine}), total + 5
        assert hits / total >= 0.9, name


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [1.0])]
    v = spark.createDataFrame([(i, x, i, 0.5) for i, x in rows], "vec_id long, embedding array<float>, id long, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in multiindex.search(v, lambda i: i % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 8, 0.0)]
    assert multiindex.search(v.limit(0), lambda i: i % 50 == 0).count() == 0


def test_repeated_ids_and_extreme_vectors(spark):
    """No neighbour is lost to many rows of the query's id or of one other, nor to squares that overflow or vanish."""
    rng = np.random.default_rng(7)
    near = lambda: [1.0, *(rng.random(3) * 0.01).tolist()]
    rows = [(0, near()) for _ in range(90)] + [(1, near()) for _ in range(60)] + [(i, rng.normal(size=4).tolist()) for i in range(2, 12)]
    rows += [(20, [1e200, 1e200, 0.0, 0.0]), (21, [1e-200, 0.0, 0.0, 0.0]), (50, [1e200, 1e199, 0.0, 0.0]), (22, [5e-324, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multiindex.search(v, lambda i: i % 50 == 0, visit=0.05).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: len(x) for q, x in got.items()} == {0: 5, 50: 5}
    assert all(len({i for i, _ in x}) == 5 and all(np.isfinite(s) for _, s in x) for x in got.values())
    exact = {}
    for r in multiindex.search(v, lambda i: i % 50 == 0, visit=1.0).collect():
        exact.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q, found in exact.items():
        unit = lambda x: np.array(x, np.longdouble) / np.sqrt((np.array(x, np.longdouble) ** 2).sum())
        best = {}
        for i, x in rows:
            if i != q:
                best[i] = max([best.get(i, -2), *(float(unit(x) @ unit(y)) for j, y in rows if j == q)])
        want = sorted(best, key=lambda i: (-best[i], i))[:5]
        assert all(abs(found[i] - best[i]) < 1e-12 for i in found) and abs(min(best[i] for i in found) - min(best[i] for i in want)) < 1e-12


def test_traversal():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    order = multiindex.traverse(a, b, np.ones(30, int), 30)
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert len(set(order)) == 30 and sums == sorted(sums)


# 5
def test_token_counts(spark):
    library, own = Tokenizer.from_file(VOCABULARY), tokencount.Counter(open(VOCABULARY).read())
    rng = random.Random(4)
    pool = [chr(i) for i in range(1, 0x250)] + list("İσΣςé́ＡＢ한글漢字٣①²½  ‍'sSlL\n<|>") + ["<|endoftext|>", "<|startoftext|>", "'ll", "don't"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["abcdefg" * 5000, "", " "]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert [own.text(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    other = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(other), tokencount.Counter(open(other).read())
    assert [own.text(t) for t in texts[:500]] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts[:500]]


def test_token_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    library = Tokenizer.from_file(VOCABULARY)
    for r in registry.queries()["op5_token_counts"](spark, DATA).collect():
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)
    got = tokencount.count_tokens(odd(spark), VOCABULARY).collect()
    assert len(got) == 9 and [r["n_tokens"] for r in got if r["id"] in (0, 2, 3)] == [0, 0, 0]
    assert tokencount.count_tokens(odd(spark).limit(0), VOCABULARY).count() == 0


# 6
def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>é" * i) for i in range(40)] + [(None, None, None), (3, "http://h/3", "<p>é" * 3)], "page_id int, url string, html string")
    records = warc.archive(pages, 3)
    assert records.count() == 42
    for f in range(3):
        rows = records.where(F.col("file") == f).orderBy("seq").collect()
        data = b"".join(r["record"].encode() for r in rows)
        (tmp_path / f"{f}.warc").write_bytes(data)
        (tmp_path / f"{f}.warc.gz").write_bytes(b"".join(gzip.compress(r["record"].encode()) for r in rows))
        assert [(a, n) for a, n, _, _ in warc.parse(data)] == [(r["offset"], r["length"]) for r in rows]
    for kind in ("warc", "warc.gz"):
        back = warc.read(spark, f"{tmp_path}/*.{kind}")
        assert sorted(r["sha256"] for r in back.collect()) == sorted(r["sha256"] for r in records.collect())
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_audit(spark):
    leaves = [(f, s, s * 10, 10, hashlib.sha256(f"{f}/{s}".encode()).hexdigest()) for f in range(3) for s in range(70)]
    one = spark.createDataFrame(leaves, "file long, seq long, offset long, length long, sha256 string")
    hurt = [(f, s, o, n, "0" if (f, s) in {(0, 17), (2, 69)} else h) for f, s, o, n, h in leaves if (f, s) != (1, 5)] + [(1, 90, 0, 1, "e"), (None, 1, 0, 1, "e")]
    two = spark.createDataFrame(hurt, one.schema)
    got = {(r["file"], r["seq"]): r["status"] for r in warc.audit(one, two).collect()}
    assert got == {(0, 17): "corrupt", (2, 69): "corrupt", (1, 5): "missing", (1, 90): "extra"}
    assert warc.audit(one, one).count() == 0
    assert warc.audit(one.limit(0), two.limit(0)).count() == 0 and warc.audit(one.limit(0), two).where("status <> 'extra'").count() == 0
    said = {r["file"]: r["intact"] for r in warc.verdicts(warc.tree(one), warc.tree(two.where("file > 0 or seq <> 17").unionByName(one.where("file = 0 and seq = 17")))).collect()}
    assert said == {0: True, 1: False, 2: False}


def test_moved_records_and_claims_of_one_place(spark):
    leaves = [(0, s, s * 10, 10, f"{s:064x}") for s in range(40)]
    one = spark.createDataFrame(leaves, "file long, seq long, offset long, length long, sha256 string")
    moved = spark.createDataFrame([(f, s, o + 7 * (s > 5), n, h) for f, s, o, n, h in leaves], one.schema)
    assert sorted((r["seq"], r["status"], r["replica_offset"]) for r in warc.audit(one, moved).collect()) == [(s, "moved", s * 10 + 7) for s in range(6, 40)]
    twice = one.unionByName(one.where("seq = 3"))
    assert [(r["seq"], r["status"]) for r in warc.audit(one, twice).collect()] == [(3, "corrupt")] and warc.audit(twice, twice).count() == 0


def test_pages_without_ids_are_laid_in_ranges(spark):
    pages = spark.createDataFrame([(None, None, f"p{i % 7}") for i in range(500)], "page_id int, url string, html string")
    rows = warc.archive(pages, 3).orderBy("seq").collect()
    assert len({r["file"] for r in rows}) == 1 and [r["seq"] for r in rows] == list(range(500))
    at = 0
    for r in rows:
        assert r["offset"] == at
        at += r["length"]
    assert warc.archive(pages.limit(0), 3).count() == 0


# 7
def test_lookup_table():
    names = sharding.shard_names(7)
    held = sharding.fill(names, 101)
    counts = [held.count(i) for i in range(7)]
    assert min(counts) >= 1 and max(counts) - min(counts) <= 1
    # by a plain fill
    orders = []
    for n in names:
        h = hashlib.md5(n.encode()).hexdigest()
        orders.append([(int(h[:8], 16) + k * (int(h[8:16], 16) % 100 + 1)) % 101 for k in range(101)])
    want, turn = {}, 0
    while len(want) < 101:
        want[next(s for s in orders[turn % 7] if s not in want)] = turn % 7
        turn += 1
    assert held == [want[s] for s in range(101)]
    fewer = sharding.fill(names[:-1], 101)
    assert sum(a != b for a, b in zip(held, fewer, strict=True)) < 60
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placing(spark):
    docs = odd(spark)
    out = sharding.placed(docs)
    assert out.count() == 9 and out.where("doc_id = 4").select("shard_id").distinct().count() == 1
    assert [c for c in out.columns if c not in ("slot", "shard_id", "shard")] == [c for c in docs.columns if c not in ("slot", "shard")]
    assert sharding.placed(docs.limit(0)).count() == 0
    even = sharding.placed(spark.range(64_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).groupBy("shard_id").count()
    low, high = even.agg(F.min("count"), F.max("count")).first()
    assert even.count() == 64 and low > 850 and high < 1150


# 8
def brute_windows(texts, items, window=decontam.WINDOW):
    """What ``report`` has to find, by looking at every window everywhere."""
    for text in texts:
        ws = decontam.words(text)
        hit, names, longest = set(), set(), (0, 0)
        for name, item in items:
            own = decontam.words(item)
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                for at in range(len(ws) - size + 1):
                    if ws[at : at + size] == own[k : k + size]:
                        hit.update(range(at, at + size))
                        names.add(str(name))
                        n = size
                        while at + n < len(ws) and k + n < len(own) and ws[at + n] == own[k + n]:
                            n += 1
                        longest = max(longest, (n, -at))
        joined = ",".join(sorted(names))
        yield len(ws), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit), longest[0], -longest[1] if hit else None


def test_items_of_one_template(spark):
    """Windows that thousands of items share are looked up once."""
    template = " ".join(f"t{i}" for i in range(12))
    items = [(i, f"{template} item{i}") for i in range(4000)] + [(i, "a b") for i in range(4000, 4100)]
    docs = frame(spark, [(i, f"x {template} item{i}", "s") for i in range(3000)] + [(5000, "a b a b " * 50, "s")])
    got = decontam.digest_columns(decontam.report(docs, spark.createDataFrame(items, "item_id long, text string"))).collect()
    by = {r["id"]: (r["n_hit"], r["n_items"], r["longest"], r["longest_at"]) for r in got}
    assert by[5000] == (200, 100, 2, 0) and all(by[i] == (13, 4000, 13, 1) for i in range(3000))


def test_windows(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "Ee", "É", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "..."), (52, "only once")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [t.upper() + " tail" for _, t in items[:6]] + [None, "", "- -", "aa" * 9]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for block in (decontam.BLOCK_BYTES, 60):
        got = {r["id"]: tuple(r)[1:] for r in decontam.digest_columns(decontam.report(docs, bench, block_bytes=block)).collect()}
        assert got == dict(enumerate(brute_windows(texts, items)))
        kept = decontam.clean(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r[4]}


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(1, "x y " + " ".join(f"w{i}" for i in range(5, 22)) + " z", "s"), (2, " ".join(f"w{i}" for i in range(9)), "s")])
    got = [(r["id"], r["item_id"], r["item_pos"], r["doc_pos"], r["length"]) for r in decontam.matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).orderBy("item_pos").collect()]
    assert got == [(1, "7", 5 + k, 2 + k, 17 - k) for k in range(8)]
    twice = docs.where("doc_id = 1").unionByName(docs)  # all places of a longest match
    assert decontam.matches(twice, spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 16


def test_decontamination_of_odd_rows(spark):
    docs = odd(spark)
    bench = spark.createDataFrame([(1, "tie"), (None, "w"), (2, None), (3, "àé"), (1, "null")], "item_id long, text string")
    got = decontam.report(docs, bench).collect()
    assert len(got) == 9 and sorted(str(r["id"]) for r in got if r["contaminated"]) == ["4", "4", "5", "None"]
    nameless = next(r for r in decontam.digest_columns(decontam.report(docs, bench)).collect() if r["id"] == 5)
    assert (nameless["n_hit"], nameless["n_items"], nameless["items_sha256"]) == (50_000, 0, hashlib.sha256(b"").hexdigest())
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0 and decontam.report(docs.limit(0), bench).count() == 0


def test_items_without_an_id_by_the_query_s_sql(spark, tmp_path):
    """Their windows hit, in the query and in its SQL; they are in no list of items."""
    from folioscope.llm import q_decontam

    ten = " ".join(f"k{i}" for i in range(10))
    docs = [(1, f"x {ten} y"), (2, "one two"), (3, f"{ten} one two"), (None, ten), (4, None)]
    items = [(None, ten), (7, "one two"), (None, "two"), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = q_decontam.op8_benchmark_decontamination(spark, str(tmp_path))
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = c.execute(f"select {', '.join(sorted(got.columns))} from ({q_decontam.SQL['op8_benchmark_decontamination']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*sorted(got.columns)).collect())
    by = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in got.collect()}
    assert by == {1: (10, 0, True), 2: (2, 1, True), 3: (12, 1, True), None: (10, 0, True), 4: (0, 0, False)}


def test_items_without_an_id_are_cleaned_of(spark):
    docs = frame(spark, [(1, "a passage of an item", "s"), (2, "another", "s"), (3, None, "s")])
    bench = spark.createDataFrame([(None, "passage of"), (4, None)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == [2, 3]


# 9
def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    grades = quality.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    part = F.pmod(F.xxhash64("id"), F.lit(2))
    model = quality.fit(docs, grades.where(part == 0))
    rows = quality.scored(docs, model).join(grades.where(part == 1), "id").select("keep", "grade").collect()
    good = [r["keep"] for r in rows if r["grade"] == 2]
    bad = [r["keep"] for r in rows if r["grade"] < 2]
    assert len(rows) > 1500 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_ordinal_model():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(600):
        n = int(rng.integers(0, 5))
        rows.append(np.array(sorted([5] * n + rng.integers(100, 160, 4).tolist()), np.int32))
        grades.append(2 if n == 0 else 1 if n < 3 else 0)
    model = quality.fit_rows(rows, grades)
    assert model.thresholds == sorted(model.thresholds) and model.weights[5] < -1 and (model.weights <= 0).all()
    score = lambda n: float(model.weights[5]) * n
    assert model.tails(score(0))[1] > 0.5 > model.tails(score(2))[1] and model.tails(score(1))[0] > 0.5 > model.tails(score(4))[0]
    assert quality.fit_rows([], []).tails(0.0)[-1] > 0.9


def test_labels_without_documents(spark):
    """They take no place in the sample."""
    docs = frame(spark, [(i, "good words here" if i % 2 else "bad words there", "s") for i in range(0, 200)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5200)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.graded(labels), sample=20)
    assert model.weights.any()
    with pytest.warns(UserWarning, match="keeps every document"):
        assert quality.kept(docs, quality.fit(docs, quality.graded(labels.where("doc_id > 300")))).count() == 200


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (4, 1, 0), (4, 1, 1), (5, None, 0), (6, 0, 0), (7, 1, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    grades = quality.graded(labels)
    assert {r["id"]: r["grade"] for r in grades.collect()} == {0: 2, 4: 1, 6: 1, 7: 2}
    model = quality.fit(docs, grades)
    assert quality.scored(docs, model).count() == 9 and quality.kept(docs, model).columns == docs.columns
    assert quality.scored(docs.limit(0), model).count() == 0 and quality.kept(docs, quality.fit(docs, grades.limit(0))).count() == 9


# pipeline
def test_pipeline(spark):
    """Every stage against a plain version of it, over what the stage before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        before, rows = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == start.columns
        ids = {r["doc_id"] for r in rows}
        if name == "quality_classifier":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1 or quality = 0").collect()}
            good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
            assert not ids & toxic and good <= ids
        elif name == "simhash_near_dedup":
            assert len({r["text"] for r in rows}) == len(rows)
            first = {}
            for r in before:
                first.setdefault(r["text"], []).append(r["doc_id"])
            assert all(i == min(x for x in first[t]) for i, t in ((r["doc_id"], r["text"]) for r in rows))
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            hit = brute_windows([r["text"] for r in before], items)
            assert ids == {r["doc_id"] for r, h in zip(before, hit, strict=True) if not h[4]}
        elif name == "mix_sources":
            times = {r["id"]: r["times"] for r in mixing.mixed(docs).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, n in times.items() for _ in range(n)) and max(times.values()) <= 3
        else:
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before) and {r["shard_id"] for r in rows} <= set(range(64))
        docs = spark.createDataFrame(rows, out.schema) if rows else out
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_pipeline_of_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(0, None, "en", "s", 0), (None, "null id here", None, None, None), (2, "", "en", "s", 0), (3, "word " * 20_000, "en", "t", 1), (3, "word " * 20_000, "en", "t", 1), (4, "plain text of some words", "en", "t", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            docs = spark.createDataFrame(out.collect(), out.schema)
