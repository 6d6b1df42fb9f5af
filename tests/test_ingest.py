"""Sections, elements, posts, files."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import jsontext as J
from folioscope.functions import text as T
from folioscope.operators import ingest as I
from folioscope.operators import persona as P
from folioscope.sources import files, paths


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.slugify(F.lit("  Héllo, World! "))) == "h-llo-world"
    assert one(spark, T.slugify(F.lit("한글"))) == "untitled"
    assert one(spark, T.strip_markdown(F.lit("---\na: 1\n---\n# T\n\nbody  text"))) == "T body text"
    assert one(spark, T.round2(F.lit(0.285))) == 0.28 and one(spark, T.round2(F.lit(0.125))) == 0.13
    assert one(spark, T.redact(F.lit("authorization: bearer abc sk-12345678 access_token=q http://u:p@h"))) == "Authorization: Bearer <redacted> <redacted> access_token=<redacted> http://<redacted>:<redacted>@h"
    assert one(spark, T.safe_category(F.lit(" a b "))) == "a-b" and one(spark, T.safe_category(F.lit("../x"))) is None
    assert one(spark, T.slug_author(F.lit("author:a:b"))) == "a" and one(spark, T.slug_author(F.lit("author::b"))) is None
    assert one(spark, T.metadata_section(F.lit("a\nb\n## Transcript\nc"))) == "a\nb"
    assert one(spark, T.category_links(F.lit("[x](../documents/b/transcript.md) [y](../documents/a/transcript.md)"))) == ["a", "b"]


def test_json(spark):
    assert one(spark, J.stable_json(b=F.lit(1), a=F.lit(None).cast("string"), c=F.lit("x"))) == '{"b":1,"c":"x"}'
    assert J.leaves('{"a":[{"b":1},null],"c":{},"d":"é"}') == [(1, "$.a[0].b", "1"), (2, "$.a[1]", "null"), (3, "$.d", '"é"')]
    assert J.leaves("{") == [] and J.leaves(None) == []


def test_sections(spark):
    text = "lost\n# One\nbody\n## Two\nmore\n#### deep\n# Two-\nlast"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "id int, t string")
    got = [(r["id"], r["ord"], r["title"], r["body"]) for r in I.sections(df, "id", "t").orderBy("id", "ord").collect()]
    assert got == [(1, 1, "One", "# One\nbody"), (1, 2, "Two", "## Two\nmore\n#### deep"), (1, 3, "Two-", "# Two-\nlast"), (2, 1, "Untitled", "plain"), (3, 1, "Untitled", "")]
    rows = I.distinct_titles(I.sections(df, "id", "t"), "id", "ord")
    assert [r["title"] for r in rows.where("id = 1").orderBy("ord").collect()] == ["One", "Two", "Two- 2"]
    by = I.sections_by(df, "id", "t", r"^## (.+)$")
    assert [r["title"] for r in by.where("id = 1").collect()] == ["Two"]


def test_oversize(spark):
    df = spark.createDataFrame([("x", 1, "T", "# T " + " ".join(["w"] * 8005))], "id string, ord int, title string, body string")
    got = I.oversize(df).orderBy("part").collect()
    assert [r["title"] for r in got] == ["T", "T 2"] and len(got[1]["body"].split()) == 7


def test_elements_and_chunks(spark):
    text = "# H\n\n- item\n```\ncode\n\n# still code\n```\na | b\nword"
    df = spark.createDataFrame([(1, text, "f.md"), (2, None, "g.md"), (3, "x", "h.md")], "id int, t string, f string")
    rows = I.elements(df, "id", "t", "f")
    assert [r["kind"] for r in rows.where("doc_id = 1").orderBy("line_start").collect()] == ["heading", "list", "code", "code", "code", "code", "table", "paragraph"]
    ids = [r["chunk_id"] for r in I.chunks(rows, "line_start").orderBy("doc_id", "line_start").collect()]
    assert ids[0] == "1:e1:c1" and ids[-1] == "3:e1:c9"


def test_store(spark, tmp_path):
    posts = files.import_author(spark, "demo-author", "# A\none\n# a!\ntwo")
    assert [r["slug"] for r in posts.orderBy("slug").collect()] == ["author:demo-author:a", "author:demo-author:a-2"]
    for r in files.post_files(posts).collect():
        path = tmp_path / "authors" / r["path"]
        path.parent.mkdir(parents=True)
        path.write_text(r["value"])
    back = files.read_posts(spark, str(tmp_path / "authors"))
    assert back.orderBy("slug").collect() == posts.select(*back.columns).orderBy("slug").collect()
    assert files.read_posts(spark, str(tmp_path / "none")).count() == 0
    files.write_posts(posts, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    got = files.inline(spark, '{"k":"A","text":"x"}\n\n{"k":"A","content":"y"}', "a.jsonl", "k").first()
    assert got["title"] == "A" and got["body"] == "# A\n\nx\ny"
    with pytest.raises(ValueError):
        files.inline(spark, '{"q":"A"}', "a.jsonl", "k")
    with pytest.raises(ValueError):
        files.import_author(spark, "Demo Author", "x")


def test_documents_and_categories(spark, tmp_path):
    d = tmp_path / "documents" / "ep-1"
    d.mkdir(parents=True)
    (d / "transcript.md").write_text("---\ntitle: 'T'\nguest: G\nview_count: \"12\"\npublish_date: 2024-01-02\nkeywords:\n- a\n- \"b\"\n---\nintro\n## Transcript\n\nhello there\n")
    row = files.read_transcripts(spark, str(tmp_path / "documents")).first()
    assert (row["slug"], row["title"], row["view_count"], row["keywords"], row["transcript"], row["word_count"]) == ("ep-1", "T", 12.0, ["a", "b"], "hello there", 2)
    (tmp_path / "documents.jsonl").write_text('{"slug":"x","transcript":"one two"}\n\n{"slug":"y","content":"c"}\n')
    lines = files.read_document_jsonl(spark, str(tmp_path / "documents.jsonl"))
    assert {r["slug"]: (r["content"], r["word_count"]) for r in lines.collect()} == {"x": ("one two", 2), "y": ("c", 1)}
    assert files.merge_by_slug(lines, files.read_transcripts(spark, str(tmp_path / "documents"))).count() == 3
    with pytest.raises(ValueError, match="more than once"):
        files.merge_by_slug(lines, lines)
    (tmp_path / "bad.jsonl").write_text('{"slug":"x"}\n{oops\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        files.read_document_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    c = tmp_path / "categories"
    c.mkdir()
    (c / "README.md").write_text("# no")
    (c / "growth.md").write_text("intro\n# Growth\n- [E](../documents/ep-1/transcript.md)\n")
    row = files.read_categories(spark, str(c)).collect()
    assert [(r["slug"], r["name"], r["documentSlugs"]) for r in row] == [("growth", "Growth", ["ep-1"])]
    assert files.current_hashes(spark, str(tmp_path / "documents"), str(tmp_path / "documents.jsonl"), str(tmp_path / "none")).count() == 3


def test_folder(spark, tmp_path):
    (tmp_path / "note.md").write_text("# 제목\n\ntext\n- item\n")
    (tmp_path / "data.json").write_text(json.dumps({"a": [1, {"b": "x"}]}))
    got = files.read_folder(spark, str(tmp_path)).collect()
    assert sorted((r["kind"], r["text"]) for r in got) == [("heading", "# 제목"), ("json", '"x"'), ("json", "1"), ("list", "- item"), ("paragraph", "text")]
    (tmp_path / "bad.json").write_text('{"a":')
    with pytest.raises(Exception, match="Invalid JSON"):
        files.read_folder(spark, str(tmp_path)).collect()


def test_guards(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out.md").write_text("x")
    (tmp_path / "in" / "link.md").symlink_to(tmp_path / "out.md")
    (tmp_path / "in" / "a.md").write_text("x")
    assert paths.import_file(str(tmp_path / "in"), "a.md").name == "a.md"
    for bad in ("../out.md", "link.md", str(tmp_path / "out.md")):
        with pytest.raises(ValueError):
            paths.import_file(str(tmp_path / "in"), bad)
    assert paths.source_id("author:a.b") == "author:a.b"
    with pytest.raises(ValueError):
        paths.source_id("author:-x")


def test_gates(spark):
    m = spark.createDataFrame([(0.9, 0.85, 0.1, 0.05, 0.95), (0.5, 0.8, 0.2, 0.0, 0.9), (None, 0.8, 0.0, 0.0, 0.9)], "retrieval_adherence double, consistency double, pcr double, scr double, human_similarity double")
    assert [r["failures"] for r in P.evaluate(m).collect()] == ["", "retrieval_adherence,pcr", ""]
    assert P.evaluate(m, defaults=False).collect()[2]["failures"] == "retrieval_adherence"
    p = spark.createDataFrame([("a", None, 2), ("b", "c", 0)], "author_id string, caveat string, n_claims int")
    assert [(round(r["average"], 3), r["pass"]) for r in P.judge(p).collect()] == [(6.0, True), (4.667, False)]
    claims = spark.createDataFrame([("a", "claim-1", "t", None, None, None, None, None, 1)], "author_id string, claim_id string, text string, quote string, chunk_id string, element_id string, doc_id string, source_file string, line_start int")
    assert P.provenance_failures(claims).first()["failure"] == "missing evidence"
    with pytest.raises(ValueError):
        P.debate(spark, claims, ["a"], "q", 6)
    with pytest.raises(Exception, match="missing citation"):
        P.debate(spark, claims, ["a", "z"], "q", 1).collect()
