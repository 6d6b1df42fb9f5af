"""Texts many to a file: what a corpus of posts or transcripts takes in files, and that they say what single files say."""

import glob

import pytest
from pyspark.sql import functions as F

from folioscope.catalogue import folders
from folioscope.sources import files

DATA = "/root/testdata/sf0.001"


def test_bundles_say_what_single_files_say(spark, tmp_path):
    texts = [("a", f"p{i}", "---\n{\n" + f'"author_id": "a", "document_slug": "p{i}"' + "\n}\n---\n\n" + t) for i, t in enumerate(["one", "two\r\nlines\n", "", "ü 漢\n\n---\nx"])] + [("a", "bad", "---\n{broken\n---\nx"), ("b", "q", "no front"), ("b", "e", "")]
    rows = spark.createDataFrame(texts, "author_id string, document_slug string, value string")
    files.write_texts(rows, f"{tmp_path}/each", "author_id", "document_slug")
    files.write_bundles(rows.withColumn("path", F.concat_ws("/", "author_id", F.lit("posts"), "document_slug", F.lit("post.md"))), f"{tmp_path}/many", "author_id")
    read = lambda folder, author, layout: sorted(map(repr, files.read_posts(spark, f"{tmp_path}/{folder}", author, layout).collect()))
    for author, n in (("a", 4), ("b", 0), ("*", 4), ("none", 0)):
        got = read("many", author, files.POST_BUNDLES)
        assert got == read("each", author, files.POST_PARTS) and len(got) == n
    assert files.whole(spark, f"{tmp_path}/many/{files.POST_BUNDLES.format(author='b')}").count() == 2


@pytest.mark.parametrize("query, layout", [(folders.q94, "author_id=*/*.parquet"), (folders.q94b, "author_id=*/*.parquet"), (folders.q95, "*.parquet")])
def test_folders_of_texts_take_few_files(spark, tmp_path, monkeypatch, query, layout):
    """Files grow with authors and tasks, not with documents; one author's posts are read out of one folder."""
    monkeypatch.setattr(folders, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    found = query(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    written = glob.glob(f"{tmp_path}/*/{layout}")
    assert 0 < len(written) <= docs.select("source").distinct().count() + spark.sparkContext.defaultParallelism + 1 < docs.count()
    if query is folders.q94b:
        assert {f.split("author_id=")[1].split("/")[0] for f in found.inputFiles()} == {"src03"}
