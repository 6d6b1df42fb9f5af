"""Numbers of the log, records of compactions, deep JSON, the digest's levels, lists of clones."""

import hashlib
import json

import pytest

from folioscope import service, storage
from folioscope.functions.jsontext import deep, leaves
from folioscope.operators import catalog as K
from folioscope.operators import clones as L
from folioscope.operators import lifecycle as E


def test_deep_json():
    for text in ('{"a": [1, {"b": null}], "c": {}, "d": "x", "a": 2}', '[[], {"k": [1.5, true]}]', "3", "", '{"a":}', "[1,2", "[1]x", '{"a" 1}', " [ 1 , 2 ] ", '{"a":[{"b":{}}],"c":[[1]]}', "[1,]", '{"a":1,}'):
        try:
            want = json.loads(text)
        except ValueError:
            with pytest.raises(ValueError):
                deep(text)
        else:
            assert deep(text) == want
    assert [x[::2] for x in leaves("[" * 60_000 + "7" + "]" * 60_000)] == [(1, "7")] and leaves("[" * 60_000) == []


def test_digest_of_more_levels(spark, monkeypatch):
    rows = [(f"s{i}", f"text {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "slug string, content string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def plain(digits):
        nodes = {}
        for slug, text in sorted(rows):
            nodes.setdefault(hashlib.md5(slug.encode()).hexdigest()[:digits], []).append(f"{slug} {sha(text)[:16]}")
        nodes = {b: (len(x), sha("\n".join(x))) for b, x in nodes.items()}
        while digits:
            digits -= 3
            above = {}
            for b, (n, h) in sorted(nodes.items()):
                above.setdefault(b[:digits], []).append((n, f"{b} {n} {h}"))
            nodes = {b: (sum(n for n, _ in x), sha("\n".join(t for _, t in x))) for b, x in above.items()}
        return nodes[""][1][:16]

    assert K.digest(df).first()[0] == plain(3)
    monkeypatch.setattr(K, "BUCKET", 0.01)
    assert K.digest(df).first()[0] == plain(6)


def test_log_keeps_its_order_when_clocks_step_back(spark, tmp_path, monkeypatch):
    memory = service.DocumentMemory(spark, str(tmp_path / "store"))
    monkeypatch.setattr(service, "LINES", 3)
    times = iter(["2024-01-03", "2024-01-01", "2024-01-02", "2024-01-01"])
    monkeypatch.setattr(service, "now", lambda: f"{next(times)}T00:00:00.000Z")
    with memory._lock():
        for action in ("import", "refresh", "delete", "import"):
            memory._record("author:a", action, 1)
    assert [r["action"] for r in memory.history().orderBy("line").collect()] == ["import", "refresh", "delete", "import"]
    assert [r["line"] for r in memory.events().orderBy("line").collect()] == [1, 2, 3, 4] and len(memory.table("log").inputFiles()) == 2
    assert storage.next_number(spark, f"{memory.root}/lines") == 5
    monkeypatch.setattr(service, "now", lambda: "2024-01-05T00:00:00.000Z")
    memory._put("compactions", spark.createDataFrame([("author:a", 1, -1, 0, "2024-01-01T00:00:00.000Z", "x")], service.COMPACTIONS))
    before = memory._paths("log")
    with pytest.raises(ValueError, match="no count"):
        memory.compact("author:a", 1)
    assert memory._paths("log") == before
    bad = [("x", 1, 1, 1, "2024-01-01", "b"), ("author:a", 1, 1, 1, "soon", "b"), ("author:a", 1, None, 1, "2024-01-01", "b"), ("author:a", 1, 1, 1, "2024-01-01", ""), ("author:a", 0, 0, 0, "2024-01-01T00:00:00.000Z", "b")]
    assert sorted(r["problem"] for r in E.bad_compactions(spark.createDataFrame(bad, service.COMPACTIONS)).collect()) == ["no backup", "no count", "no source", "no time"]


def test_clones_listed(spark):
    clones = spark.createDataFrame([("a", None), ("b", "no narrative")], "name string, problem string")
    turns = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "a"), ("s3", "z"), ("s4", None)], "session_id string, author_id string")
    assert sorted(map(tuple, L.listed(clones, turns).collect())) == [("a", None, 2, 3), ("b", "no narrative", 0, 0)]
