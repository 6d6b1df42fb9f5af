"""SimHash near-dedup, components and repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from folioscope.llm import components, registry, repeats, simhash

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, fingerprint string, tid int, copies int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "q", 2, 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def brute_fingerprint(text):
    folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius):
    """Smallest index reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i + 1, len(prints)):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in registry.queries()["op10_simhash_near_dedup"](spark, DATA).collect()}
    prints = [brute_fingerprint(d["text"]) for d in docs]
    least = groups(prints, 4)
    assert len(got) == len(docs)
    for d, p, g in zip(docs, prints, least, strict=True):
        assert got[d["doc_id"]]["fingerprint"] == f"{p:016x}" and got[d["doc_id"]]["component_id"] == docs[g]["doc_id"]


@pytest.mark.parametrize("hot", [8, 40, 4096])
def test_links(spark, hot):
    """Dense and loose clusters: components of the links are those of all pairs, also when groups are dealt out."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    for _ in range(40):  # a chain
        prints.add(centre)
        for _ in range(4):
            centre ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(f"{p:016x}",) for p in prints], "fingerprint string")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(nodes, 64, 4, hot)).collect()}
    want = groups(prints, 4)
    named = [roots.get(f"{p:016x}", f"{p:016x}") for p in prints]
    assert len(set(zip(want, named, strict=True))) == len(set(want)) == len(set(named))


@pytest.mark.parametrize("hot", [4, 4096])
def test_wide_links(spark, hot):
    rng = random.Random(6)
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 15))) for c in [rng.getrandbits(128) for _ in range(30)] for _ in range(5)})
    nodes = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(nodes, 128, 15, hot)).collect()}
    named = [roots.get(f"{p:032x}", f"{p:032x}") for p in prints]
    want = groups(prints, 15)
    assert len(set(zip(want, named, strict=True))) == len(set(want)) == len(set(named))


def test_components(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (None, 3), (5, 6), (6, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert len(roots) == 61 + 200 and len({roots[i] for i in range(61)}) == 1 and len({roots[1000 + i] for i in range(200)}) == 1 and roots[0] != roots[1000]
    assert components.connected_components(edges.limit(0)).count() == 0


def test_edges_of_near_dedup(spark):
    long = "word " * 100_000
    texts = [None, "", " \t", "one", "One", long, long + "x", "a b c d e f"]
    docs = frame(spark, texts, [0, 1, None, 3, 4, 5, 6, 7])
    got = simhash.near_duplicates(docs.union(docs.where("doc_id = 7"))).collect()
    by = {r["id"]: r["component_id"] for r in got}
    assert len(got) == 9 and by[None] == by[1] == by[0] == 0 and by[4] == 3 and by[6] == 5 and by[7] == 7
    kept = simhash.keep_one(docs.union(docs.where("doc_id = 7")))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 5, 6, 7]  # 6 has a word of its own, and but one other
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
    nobody = frame(spark, ["x", "x"], [None, None])
    assert [r["component_id"] for r in simhash.near_duplicates(nobody).collect()] == [None, None] and simhash.keep_one(nobody).count() == 1


def test_near_copies_are_caught(spark):
    """Five-word shingles 0.8 alike or more: one of each group stays; other texts stay."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts, copies = [], 0
    for _ in range(40):
        own = [word() for _ in range(rng.randint(150, 600))]
        texts.append(" ".join(own))
        near = list(own)
        for k in rng.sample(range(len(near)), max(1, len(near) // 60)):
            near[k] = word()
        shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (own, near)]
        if len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) >= 0.8:
            texts.append(" ".join(near))
            copies += 1
    assert copies > 20 and simhash.keep_one(frame(spark, texts)).count() == 40


def jaccard_kept(texts, least=0.8):
    """Indices that stay when one of each component of pairs ``least`` alike in five-word shingles does."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


@pytest.mark.parametrize("held", [3, 256])
def test_only_copies_of_eight_tenths_go(spark, held):
    """Pairs below 0.8 both stay, and long texts of few words with new words in them are met too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = []
    for share in (12, 30, 45, 100):  # one word of so many is another
        own = [word() for _ in range(400)]
        for _ in range(8):
            near = list(own)
            for k in rng.sample(range(len(near)), len(near) // share):
                near[k] = word()
            texts.append(" ".join(near))
    own = [word() for _ in range(300)]
    texts += [" ".join(own), " ".join(reversed(own)), " ".join(sorted(own))]  # the same words, other shingles
    few = [word() for _ in range(40)]
    long = [rng.choice(few) for _ in range(4000)]
    new = list(long)
    for k in rng.sample(range(len(new)), 40):
        new[k] = word()
    texts += [" ".join(long), " ".join(new), "a b c d e f g h i", "a b c d e f g h j", "one two", "One Two", "one two three"]
    got = {r["doc_id"] for r in simhash.keep_one(frame(spark, texts), held=held).collect()}
    want = jaccard_kept(texts)
    assert got == want and {32, 33, 34, 35} <= want and 36 not in want


@pytest.mark.parametrize("held", [2, 5, 256])
def test_groups_of_many_blocks(spark, held):
    """One group of candidates, made by hand, of one large tree, smaller ones, chains and texts by themselves."""
    rng = random.Random(held)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))

    def near(own):
        out = list(own)
        out[rng.randrange(len(out))] = word()
        return out

    texts = []
    for n in (40, 7, 2, 1, 1):
        own = [word() for _ in range(120)]
        texts += [near(own) for _ in range(n)]
    chain = [word() for _ in range(120)]
    for _ in range(12):  # neighbours are alike, ends aren't
        chain = near(chain)
        texts.append(chain)
    texts = [" ".join(t) for t in texts]
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    rows = spark.createDataFrame(list(zip(range(len(texts)), digests, texts, strict=True)), "id long, digest string, text string")
    group = rows.selectExpr("id", "digest AS node", "if(id = 50, 'other', 'all') AS root")
    links = simhash.confirmed(rows, group, held=held)
    root = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    found = [root.get(d, d) for d in digests]
    want = jaccard_kept(texts)
    assert len(set(found)) == len(want) and len({found[i] for i in want}) == len(want)


def passages(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [words(160)[:n] for n in (300, 398, 399, 400, 401, 440, 900)]
    texts = []
    for _ in range(150):
        t = words(rng.randint(0, 100))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice([" ", "", "\n"]) + rng.choice(shared)[rng.choice([0, 0, rng.randint(0, 60)]) :] + rng.choice([" ", "x"]) + words(rng.randint(0, 50))
        texts.append(t)
    periodic = ["abc" * 300, "a" * 1500, "a" * 399, "a" * 400, "ab" * 35_000 + words(200) + "ab" * 150, "é" * 300]
    return [*texts, None, "", *periodic, texts[3], texts[4]]


def covered(texts, length):
    """Maximal runs of bytes that strings of ``length`` cover which start twice, by counting all strings."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield t, [(m.start(), m.end()) for m in re.finditer(b"\1+", gone)]


def brute_repeats(texts):
    """(bytes, removed, spans, hash of the rest) of each text."""
    for t, runs in covered(texts, repeats.LENGTH):
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        yield len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept + t[at:]).hexdigest()


def brute_passages(texts):
    copies = Counter(texts)
    for t, runs in covered(texts, repeats.SHORT):
        yield [[a, b] for a, b in runs if len(t[a:b].split()) > repeats.WORDS or copies[t] > 1]


@pytest.mark.parametrize("hot", [3, 4096])
def test_passages(spark, hot):
    texts = passages(3)
    got = {r["id"]: r["passages"] for r in repeats.cleaned(frame(spark, texts), hot=hot).collect()}
    want = list(brute_passages([(t or "").encode() for t in texts]))
    assert [got[i] for i in range(len(texts))] == want and any(want)


@pytest.mark.parametrize("hot", [3, 4096])
def test_repeats(spark, hot):
    texts = passages(2)
    got = {r["id"]: r for r in repeats.cleaned(frame(spark, texts), hot=hot).collect()}
    for i, (n, removed, spans, kept) in enumerate(brute_repeats([(t or "").encode() for t in texts])):
        r = got[i]
        assert (r["n_bytes"], sum(b - a for a, b in r["spans"]), len(r["spans"]), r["kept_sha256"]) == (n, removed, spans, kept), i


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.queries()["op4_suffix_array_dedup"](spark, DATA).collect()}
    texts = [(d["text"] or "").encode() for d in docs]
    want = [(*w, len(p)) for w, p in zip(brute_repeats(texts), brute_passages(texts), strict=True)]
    assert got == {d["doc_id"]: w for d, w in zip(docs, want, strict=True)}


def test_repeated_rows_and_no_rows(spark):
    docs = frame(spark, ["z" * 3 + "q" * 500, "short"], [1, None])
    twice = repeats.cleaned(docs.union(docs)).collect()
    assert len(twice) == 4 and all((r["spans"] == [[0, 503]]) == (r["id"] == 1) for r in twice)
    assert repeats.cleaned(docs.limit(0)).count() == 0


def test_interval_tree():
    assert list(repeats.intervals([1, 3, 0])) == [(3, 1, 2), (1, 0, 2), (0, 0, 3)]
    rights, lefts = [b"abcX", b"abcY", b"abZ", b"ab"], [b"qr", b"qs", b"qr", b"t"]
    found = {(left, right, tuple(sorted(m.tolist()))) for left, right, m in repeats.maximal(rights, lefts, 2)}
    assert found == {(0, 2, (0, 1, 2, 3)), (1, 2, (0, 1, 2)), (2, 2, (0, 2)), (1, 3, (0, 1))}


def test_maximal_repeats(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(450))
    other = lambda: "".join(rng.choice("ijklmnop ") for _ in range(300))
    texts = [other() + "1" + shared + "2" + other(), other() + "3" + shared + "4" + other(), shared + "5" + other()]
    found = repeats.maximal_repeats(frame(spark, texts)).collect()
    assert found and max(r["length"] for r in found) == 450
    for r in found:
        strings = {texts[o["id"]][o["start"] : o["start"] + r["length"]] for o in r["occurrences"]}
        assert len(strings) == 1 and len(r["occurrences"]) == 3


def test_maximal_repeats_are_whole(spark):
    """Long repeats, equal texts and repeats within repeats, against all suffixes in order."""
    rng = random.Random(12)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, short = words(2500), words(420)
    texts = [words(50) + long + words(30), long[300:] + words(40), words(10) + long[:1700] + short, words(20) + short + words(500), words(700), "x" * 410, words(300)]
    texts += [texts[4], texts[4] + words(60), None]
    # a mark of its own after each text, and before the first
    whole, owner, start = "\u0100", [None], [0]
    for i, t in enumerate(texts):
        owner += [i] * (len(t or "") + 1)
        start += list(range(len(t or "") + 1))
        whole += (t or "") + chr(0x101 + i)
    order = sorted(range(len(whole)), key=lambda k: whole[k : k + 3000])
    common = []
    for a, b in zip(order, order[1:], strict=False):
        n = next((k for k in range(3000) if whole[a + k : a + k + 1] != whole[b + k : b + k + 1]), 3000)
        common.append(n)
    want = set()
    for n, a, b in repeats.intervals(common):
        if n >= repeats.LENGTH:
            at = order[a : b + 1]
            if len({whole[k - 1] for k in at}) > 1:
                want.add((n, tuple(sorted((owner[k], start[k]) for k in at))))
    got = [(r["length"], tuple((o["id"], o["start"]) for o in r["occurrences"])) for r in repeats.maximal_repeats(frame(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(n for n, _ in got) >= 2200 and (700, ((4, 0), (7, 0), (8, 0))) in want
    assert repeats.maximal_repeats(frame(spark, texts).limit(0)).count() == 0


def test_gram_hash_of_bytes():
    data = np.frombuffer(b"x" * 10 + bytes(range(100)) + b"x" * 10 + bytes(range(100)), np.uint8)
    h = repeats.gram_hashes(data)
    assert len(h) == len(data) - repeats.GRAM + 1 and h[10] == h[120] and h[11] == h[121] and h[10] != h[11]
