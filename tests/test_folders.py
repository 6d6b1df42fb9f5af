"""Sections of keys of any size, folders that Spark writes, guards as columns."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import export as E
from folioscope.operators import ingest as I
from folioscope.sources import files, paths


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_sections_by_key_are_those_of_the_gathered_texts(spark, size):
    """Long and blank records, ties, records that fill parts exactly, keys of several words, groups without a name."""
    rows = [("g", i, "a b" if i % 3 else "c", " ".join(f"w{i}.{j}" for j in range(i % 5 * (7 if i == 9 else 1))) + ("\n" if i % 4 == 0 else "")) for i in range(1, 40)]
    rows += [("g", 5, "a b", "tie two"), ("g", 5, "a b", None), (None, 2, "c", "  lone\ttext "), ("h", 1, "d", ""), ("h", 3, "d", None), ("x", 1, "# e", "one")]
    df = spark.createDataFrame(rows, "id string, line long, key string, text string").repartition(5)
    gathered = I.group_by_key(df, "id", "line", "key", "text").select(F.col("group").alias("id"), F.col("first_line").alias("ord"), F.col("key").alias("title"), "body")
    want = I.oversize(gathered, size)
    got = I.sections_by_key(df, "id", "line", "key", "text", size)
    plain = lambda d: sorted(map(repr, d.select("id", "ord", "part", "title", "body").collect()))
    assert plain(got) == plain(want)
    assert I.sections_by_key(df.limit(0), "id", "line", "key", "text").count() == 0
    assert I.sections_by_key(df.withColumn("key", F.lit(None).cast("string")), "id", "line", "key", "text").count() == 0


def test_json_lines_of_any_size_by_key(spark, tmp_path):
    lines = [{"k": "A", "text": "x"}, {"k": "B", "content": "z"}, {"k": "A", "content": "y", "text": "no"}, {"k": "A", "content": " "}]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    got = {r["title"]: (r["ord"], r["part"], r["body"]) for r in files.read_sections_jsonl(spark, str(tmp_path / "a.jsonl"), "k").collect()}
    assert got == {"A": (1, 1, "# A\n\nx\ny"), "B": (3, 1, "# B\n\nz")}
    with pytest.raises(Exception, match="no q at"):
        files.read_sections_jsonl(spark, str(tmp_path / "a.jsonl"), "q").collect()


def test_texts_with_a_file_each(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y", "one\ntwo"), ("a", "z", ""), ("b", "x y", "three")], "author_id string, document_slug string, value string")
    files.write_texts(rows, str(tmp_path / "t"), "author_id", "document_slug")
    found = lambda author: sorted(r["value"].strip() for r in files.whole(spark, f"{tmp_path}/t/{files.POST_PARTS.format(author=author, slug='*')}").collect())
    assert found("a") == ["", "one\ntwo"] and found("*") == ["", "one\ntwo", "three"] and found("none") == []


def test_guards_as_columns_say_what_the_guards_say(spark, tmp_path):
    names = ["a.md", "b.jsonl", "c.txt", "d/e.md", "../a.md", "/a.md", "d/../a.md", ".md", "d/.md", "A.MD", "..md", "e.md\n"]
    ids = ["author:a", "author:A._-9", "author:-a", "author:" + "a" * 128, "author:" + "a" * 129, "x:a", "author:a\n", "author:", ""]
    (tmp_path / "d").mkdir()
    for n in names:
        if ".." not in n.split("/") and not n.startswith("/"):
            (tmp_path / n).write_text("x")

    def allowed(check, *args):
        try:
            check(*args)
        except (ValueError, OSError):
            return False
        return True

    rows = spark.createDataFrame([(n, 1) for n in names], "n string, s long").select("n", paths.import_problem(F.col("n"), F.col("s")).alias("p")).collect()
    assert {r["n"]: r["p"] is None for r in rows} == {n: allowed(paths.import_file, str(tmp_path), n) for n in names}
    odd = spark.createDataFrame([(None, 1), ("a.md", None), ("a.md", paths.LARGEST_IMPORT), ("a.md", paths.LARGEST_IMPORT + 1)], "n string, s long")
    assert [r[0] for r in odd.select(paths.import_problem(F.col("n"), F.col("s"))).collect()] == ["unknown", "unknown", None, "size"]
    both = [*ids, "a-b", "a--b", "-a", "a\n", "A"]
    rows = spark.createDataFrame([(i,) for i in [*both, None]], "i string").select("i", paths.is_source_id(F.col("i")).alias("s"), paths.is_author_id(F.col("i")).alias("a")).collect()
    assert {r["i"]: (r["s"], r["a"]) for r in rows} == {i: (allowed(paths.source_id, i), allowed(paths.author_id, i)) for i in both} | {None: (False, False)}


def tree(entries, bucket):
    """The checksum of (slug, checksum) pairs by recursion from the root."""
    deep = next(d for d in (3, 6, 9, 12) if d == 12 or len(entries) <= bucket * 16**d)  # digits
    sha = lambda x: hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest()

    def node(rows, depth):
        if depth == deep:
            return sha(f"{s} {c}" for s, c in rows)
        parts = {}
        for s, c in rows:
            parts.setdefault(hashlib.md5(s.encode()).hexdigest()[: depth + 3], []).append((s, c))
        return sha(f"{k} {len(v)} {node(v, depth + 3)}" for k, v in parts.items())

    return node(entries, 0)


@pytest.mark.parametrize("bucket", [1000, 1e-2, 1e-9])
def test_tree_checksums_at_any_depth(spark, bucket):
    """Sources of several sizes have trees of several depths; a source's checksum hangs on its own documents alone."""
    rows = [("a", f"s{i}", f"c{i}", 2) for i in range(90)] + [("b", "s1", "c1", 2), ("b", "s1", "c1", 2), ("c", "s2", "c2", 0)]
    df = spark.createDataFrame(rows, "source_id string, slug string, checksum string, content_bytes long")
    want = {k: tree([(s, c) for o, s, c, _ in rows if o == k], bucket) for k in "abc"}
    got = E.tree_checksums(df.repartition(4), bucket).collect()
    assert {r["source_id"]: r["tree_checksum"] for r in got} == want and {r["source_id"]: r["document_count"] for r in got} == {"a": 90, "b": 2, "c": 1}
    alone = E.tree_checksums(df.where("source_id = 'b'"), bucket).first()
    assert alone["tree_checksum"] == want["b"] and alone["content_bytes"] == 4
    assert E.tree_checksums(df.limit(0)).count() == 0
