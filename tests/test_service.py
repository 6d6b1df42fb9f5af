"""A source's life from import to deletion."""

import pytest
from pyspark.sql import functions as F

from folioscope import storage
from folioscope.operators import search as S
from folioscope.service import DocumentMemory, NotFound, as_markdown
from folioscope.sources import files


def test_life_of_a_source(spark, tmp_path):
    memory = DocumentMemory(spark, str(tmp_path / "store"), str(tmp_path / "authors"))
    assert not memory.ready()["ready"] and memory.sources().count() == 0
    text = "# Alpha\nsome words on alpha\n## Beta\nother words"
    assert memory.import_author("demo", text, dry_run=True).count() == 2 and memory.documents().count() == 0
    assert {r["action"] for r in memory.import_author("demo", text).collect()} == {"added"}
    again = memory.import_author("demo", text.replace("other", "more"))
    assert sorted(r["action"] for r in again.collect()) == ["skipped", "updated"]
    memory.import_author("second", "# Gamma\nalpha too")
    assert [r["slug"] for r in memory.search("alpha").orderBy("rank").collect()] == ["author:demo:alpha", "author:second:gamma"]
    assert memory.compare("alpha").count() == 2 and memory.explain("alpha").count() == 3
    assert memory.document("author:demo:beta", "summary").startswith("## Beta")
    with pytest.raises(NotFound):
        memory.document("author:demo:none")
    one = {r["source_id"]: r for r in memory.sources().collect()}["author:demo"]
    assert (one["document_count"], one["interaction_count"], one["last_action"]) == (2, 2, "import")
    assert memory.stats()["document_count"] == 3 and memory.stats()["sources"] == 2
    memory.set_categories(spark.createDataFrame([("growth", ["author:demo:alpha", "author:no:no"])], "slug string, documentSlugs array<string>"))
    assert memory.search("alpha", category="growth").count() == 1
    rows, manifest = memory.export("author:demo", history=True)
    assert rows.count() == 2 and manifest.first() == memory.export("author:demo", history=True)[1].first()
    assert memory.compact("author:demo", 1)["removed"] == 1 and memory.status("author:demo").first()["compacted"]
    assert memory.history("author:demo").count() == 1
    assert memory.refresh("author:demo") == {"source_id": "author:demo", "status": "failed", "reason": "missing-storage", "added": 0, "updated": 0, "skipped": 0}
    for r in files.post_files(files.import_author(spark, "demo", text)).collect():
        path = tmp_path / "authors" / r["path"]
        path.parent.mkdir(parents=True)
        path.write_text(r["value"])
    assert memory.refresh("author:demo", dry_run=True)["status"] == "changed" and memory.refresh("author:demo")["updated"] == 1
    assert memory.refresh("author:demo")["status"] == "unchanged"
    assert memory.delete("author:demo") == 2 and memory.documents().count() == 1
    assert memory.history("author:demo").orderBy(F.desc("line")).first()["action"] == "delete"
    with pytest.raises(NotFound):
        memory.source("author:demo")
    with pytest.raises(ValueError):
        memory.status("demo")
    assert "Gamma" in as_markdown("Results", memory.search("alpha")) and "Nothing found." in as_markdown("Results", memory.search("zzz"))


def test_index_is_kept_up(spark, tmp_path):
    """Searches by the index find what a scan finds, through imports and deletions."""
    memory = DocumentMemory(spark, str(tmp_path / "store"))
    memory.import_author("demo", "# Alpha\nsome words on alpha\n## Beta\nother words")
    memory.reindex()
    assert memory._engine() is not None and memory.ready()["index"]
    memory.import_author("demo", "# Alpha\nnothing of it\n## New\nalpha alphabet")
    memory.import_author("other", "# Gamma\nalpha too")
    assert memory._engine() is not None
    slugs = lambda: [r["slug"] for r in memory.search("alpha").orderBy("rank").collect()]
    assert slugs() == [r["slug"] for r in S.search(memory.documents(), S.Search("alpha")).orderBy("rank").collect()] and "author:other:gamma" in slugs()
    memory.delete("author:other")
    assert memory._engine() is not None and "author:other:gamma" not in slugs()
    assert memory._engine().merge().documents().count() == memory.documents().count()
    broken = memory.search("alpha", reranker=lambda rows: 1 / 0).first()
    assert (broken["rerank_applied"], broken["rerank_reason"]) == (False, "ZeroDivisionError")
    with pytest.raises(NotFound):
        memory.refresh("author:nobody") if memory.authors else memory.source("author:nobody")


def test_lock(spark, tmp_path):
    path = str(tmp_path / "lock")
    with storage.locked(spark, path):
        with pytest.raises(TimeoutError):
            with storage.locked(spark, path, wait_s=0.1):
                pass
        with storage.locked(spark, path, wait_s=0.1, stale_s=-1):  # one that was left
            pass
    with storage.locked(spark, path, wait_s=0.1):
        pass


def test_import_of_files(spark, tmp_path):
    memory = DocumentMemory(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("== One\nx\n== Two\ny")
    assert memory.import_file("demo", str(tmp_path / "in"), "a.md", split_by=r"^== (.*)$").count() == 2
    for name in ("../a.md", "b.md", "a.txt"):
        with pytest.raises((ValueError, OSError)):
            memory.import_file("demo", str(tmp_path / "in"), name)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.log").write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.numbered_lines(spark, f"{tmp_path}/*.log").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4000 and all(r["value"] == f"line {r['line']}" for r in rows)
    assert files.numbered_lines(spark, f"{tmp_path}/none/*.log").count() == 0
