"""Operators 12 and 13 against plain Python."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from folioscope.llm import filteraudit, fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, id long, n int, form string, hash string, part string, first boolean, good boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "f", "h", "p", True, False) for i, t, s in rows], SCHEMA)


def plain(i, text, rate=50, spm=80):
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    x, y, z = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < spm:
        return len(tokens), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(tokens), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def texts(n):
    rng = random.Random(5)
    pieces = ["a", "ü", "漢", "😀", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\xa0", " ", "\x85", "<P>", "<S", ">", "<", "M>", "P", "word", "\x1c", "\x00"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_cuts_against_plain_code():
    events = fim.automaton()
    for i, text in enumerate(texts(5000)):
        got = fim.rewritten(text, i, events, 100)
        assert got == plain(i, text, 100)
        assert fim.restored(got[4], got[1]) == text


def test_rows_cut(spark):
    long = "w " * 200_000 + "x" * 100_000
    rows = [(i, t, "en") for i, t in enumerate(texts(500))] + [(None, "null id", "en"), (-3, None, None), (7, "a b c", "en"), (7, "a b c", "en"), (2, long, "en"), (9, " ", "en"), (10, "a<P>b", "en")]
    got = fim.transformed(frame(spark, rows).repartition(6)).collect()
    assert Counter((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got) == Counter((i, *plain(i, t or ""), t or "") for i, t, _ in rows)
    assert fim.transformed(frame(spark, rows).limit(0)).count() == 0
    forms = Counter(r["form"] for r in fim.transformed(frame(spark, [(i, "a b c d", "en") for i in range(3000)])).collect())
    assert 1350 < forms["plain"] < 1650 and 0.76 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.84


def audited(rows, labels):
    """Every order, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in d[1] for d in everyone) - len(gone), sum(d[1] == {f} for d in everyone), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, rows, labels):
    got = filteraudit.audit(filteraudit.flagged(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string, id long"))).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got}
    assert len(found) == len(got) and found == audited(rows, [x[:3] for x in labels])


def test_audit_against_every_order(spark):
    rng = random.Random(11)
    bodies = [" ".join(rng.choice(["word", "Big", "x$", "tiny", *map(str, range(400))][: rng.choice([3, 60, 404])]) for _ in range(rng.choice([5, 150, 250]))) for _ in range(60)]
    rows = [(i, rng.choice(bodies), rng.choice(["en", "de", None, ""])) for i in range(200)]
    check(spark, rows, [(rng.randint(0, 220), rng.randint(0, 1), rng.randint(0, 1), "p", 1) for _ in range(150)])


def test_audit_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " \n", "en"), (None, "same", "en"), (4, "same", "en"), (5, "same", "fr"), (5, "same", "fr"), (6, "É" * 1000 + "A" * 31, "en"), (7, "w " * 100_000, "en"), (8, "|", "en"), (None, "same", None)]
    check(spark, rows, [(4, 1, None, "p", 1), (4, 0, 1, "p", 1), (None, 1, 1, "p", 1), (5, None, 1, "p", 1), (99, 1, 1, "p", 1)])
    none = frame(spark, rows).limit(0)
    assert filteraudit.audit(filteraudit.flagged(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


@pytest.mark.parametrize("columns", [("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
def test_audit_query_has_every_order(spark, columns):
    from folioscope.llm.q_filteraudit import op13_filter_audit

    got = op13_filter_audit(spark, "/root/testdata/sf0.001")
    assert set(columns) <= set(got.columns)
    assert got.count() == 600 * got.select("part").distinct().count() and got.select("filter_order").distinct().count() == 120
