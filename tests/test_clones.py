"""Persona files there and back."""

import pytest

from folioscope.operators import clones as C


def test_there_and_back(spark):
    personas = spark.createDataFrame([("sol", "Sol", "Careful", ["vc", "expert"], None, ["dry", "calm"], None), ("bo", None, None, ["tech"], "tech", None, ["Few sources."])], "author_id string, display_name string, tagline string, categories array<string>, primary_category string, voice_traits array<string>, caveats array<string>")
    claims = spark.createDataFrame([("sol", "claim-1", "First.", "a quote", "m.md", 1), ("sol", "claim-2", "Second.", "more", "m.md", 2)], "author_id string, claim_id string, text string, quote string, source_file string, line_start int")
    files = C.render(personas, claims)
    got = {r["author_id"]: r for r in C.parse(files.selectExpr("author_id as name", "text as value")).collect()}
    assert got["sol"]["problem"] is None and got["sol"]["narrative"] == "First." and got["sol"]["categories"] == ["vc", "expert"] and got["sol"]["primary_category"] == "vc"
    assert got["bo"]["problem"] is None and got["bo"]["narrative"] == C.NO_CLAIM and got["bo"]["guidelines"] == f"Few sources. {C.DISCLAIMER}"
    assert "- a quote (m.md:1)\n- more (m.md:2)" in {r["author_id"]: r["text"] for r in files.collect()}["sol"]


def test_problems(spark):
    head = "---\nname: a\ncategories: vc\nnot_real_person: true\n---\n"
    body = "## Persona Narrative\nx\n## Speaking style\ny\n## Guidelines\nsimulated\n## Background\n"
    cases = {
        "none": ("a", head + body), "no front matter": ("a", body), "name differs from folder": ("b", head + body), "not_real_person is not declared": ("a", head.replace("true", "no") + body),
        "no categories": ("a", head.replace("vc", "") + body), "unknown category": ("a", head.replace("vc", "vc,zz") + body), "no disclaimer": ("a", head + body.replace("simulated", "z")),
        "sections missing or out of order": ("a", head + body.replace("Guidelines", "Other")), "no narrative": ("a", head + body.replace("x\n", "\n")),
    }
    rows = spark.createDataFrame([(n, v) for n, v in cases.values()], "name string, value string")
    assert [r["problem"] or "none" for r in C.parse(rows).collect()] == list(cases)


def test_register(spark):
    docs = spark.createDataFrame([("d", "/x/d.md")], "doc_id string, source string")
    assert C.knowledge(docs, "Notes", "growth talk", "url", "2024-01-02").first()["stub"] == "2024-01-02-growth-talk.md"
    assert C.knowledge(docs, "Notes").first()["stub"] is None
    for bad in ({"source_type": "tape"}, {"published_at": "2024"}):
        with pytest.raises(ValueError):
            C.knowledge(docs, "Notes", **bad)
    personas = spark.createDataFrame([("a", ["vc"]), ("b", ["tech"])], "author_id string, categories array<string>")
    lenses = spark.createDataFrame([("vc", "Money")], "category string, label string")
    assert [(r["author_id"], r["label"]) for r in C.panel_lens(personas, lenses, "vc").collect()] == [("a", "Money")]
    with pytest.raises(ValueError):
        C.panel_lens(personas, lenses, "zz")
