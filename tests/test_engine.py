"""The index reads what its hits need, and says what a scan says."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import engine as E
from folioscope.operators import search as S


@pytest.fixture(scope="module")
def docs(spark):
    words = ["alpha", "alps", "beta", "bet", "gamma", "g", "ßig", "漢字"]
    rows = []
    for i in range(900):
        text = " ".join(words[(i * k + k) % 8] for k in range(1, 3 + i % 9))
        rows.append((f"author:a{i % 3}:d{i:04d}", f"a{i % 3}", words[i % 8] if i % 5 else None, f"guest {i % 7}", [words[i % 3]], "2024-03-01", text, text))
    return spark.createDataFrame(rows, "slug string, author_id string, title string, guest string, keywords array<string>, publish_date string, transcript string, content string")


QUERIES = ["al", "bet OR gamma", '"alpha beta" bet', "alpha g", "alpha-beta", "x? OR gamma", "ßig 漢字", '"ha be"', "alpha Alpha"]


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory, monkeypatch_module):
    monkeypatch_module.setattr(E, "DOCUMENTS_A_PART", 50)
    return E.IndexEngine.build(docs, f"file://{tmp_path_factory.mktemp('index')}", "k")


@pytest.fixture(scope="module")
def monkeypatch_module():
    with pytest.MonkeyPatch.context() as m:
        yield m


def same(one, two, wanted):
    rows = [S.results(e, wanted).select("slug", "raw", "score").orderBy("slug").collect() for e in (one, two)]
    assert rows[0] == rows[1], wanted
    pages = [[tuple(r) for r in S.search(e, wanted).orderBy("rank").collect()] for e in (one, two)]
    assert pages[0] == pages[1], wanted


@pytest.mark.parametrize("query", QUERIES)
def test_index_says_what_a_scan_says(docs, index, query):
    same(index, docs, S.Search(query, mode="rrf" if len(query) % 2 else "weighted"))


def test_segments(docs, index, spark):
    changed = docs.where("slug like '%1'").withColumn("title", F.lit("gamma gamma"))
    grown = index.add(changed, "more").remove(docs.where("slug like '%7'"), "less")
    left = docs.where("slug not like '%7' and slug not like '%1'").unionByName(changed)
    for query in ("gamma", "alpha beta", '"gamma gamma"'):
        same(grown, left, S.Search(query))
    same(grown.merge(), left, S.Search("gamma"))


def test_only_the_folders_of_hits_are_read(docs, index):
    """A search reads few documents' folders and one shard a prefix, and no text but of its hits."""
    wanted = S.Search("ßig", guest="guest 3")
    rows = index.matches(wanted)
    hits = {r[0] for r in index._found(S.parse_query("ßig"), "weighted")}
    assert 0 < len(hits) < 900
    read = {f.split("/part=")[1].split("/")[0] for f in index.documents_of(sorted(hits)[:3]).inputFiles()}
    assert 1 <= len(read) <= 3
    shards = {f.split("/shard=")[1].split("/")[0] for f in index._postings_of(["ßig"]).inputFiles()}
    assert len(shards) == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    read = [x.split(">")[0] for x in plan.split("ReadSchema: struct<")[1:]]
    assert read and not any("transcript:" in x or "content:" in x for x in read)
    assert index.documents_of([]).count() == 0 and index.documents_of(["none"]).count() == 0
