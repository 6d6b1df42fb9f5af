"""Tools, HTTP, settings, providers, the command line and chats."""

import io
import json

import pytest

from folioscope.__main__ import main
from folioscope.operators import persona as P
from folioscope.service import DocumentMemory, NotFound
from folioscope.surface import providers
from folioscope.surface.settings import Settings
from folioscope.surface.tools import TOOLS, InvalidInput, failure, render
from folioscope.surface.web import Application


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("surface")
    (root / "imports").mkdir()
    (root / "imports" / "a.md").write_text("# Filed\nfrom a file")
    out = DocumentMemory(spark, str(root / "store"), str(root / "authors"), str(root / "imports"))
    out.import_author("demo", "# Alpha\nsome words on alpha\n## Beta\nother words")
    return out


def test_tools(memory):
    assert sorted(TOOLS) == [
        "compact_source_memory", "compare_search_explain", "delete_source", "export_source", "get_collection_stats", "get_document", "get_llm_status", "get_source",
        "get_source_history", "get_source_status", "import_author_source", "list_sources", "refresh_source", "search_documents",
    ]
    found = TOOLS["search_documents"].call(memory, query="alpha", page=1, explain=True)
    assert found["total"] == 1 and found["results"][0]["slug"] == "author:demo:alpha" and (found["offset"], found["limit"], found["page"]) == (0, 10, 1) and found["signals"]
    assert "### 1. Alpha" in render("search_documents", found) and render("search_documents", found, 20).endswith("...(truncated)")
    assert TOOLS["compare_search_explain"].call(memory, query="alpha")["overlap"] == 1
    assert "some words" in TOOLS["get_document"].call(memory, guest="DEMO", section="full")["content"]
    assert TOOLS["get_source_status"].call(memory, source_id="author:demo")["interaction_count"] == 1
    assert TOOLS["import_author_source"].call(memory, author_id="filed", file_path="a.md")["added"] == 1
    bundle = TOOLS["export_source"].call(memory, source_id="author:demo", format="markdown", include_history=True)
    assert bundle["markdown"].startswith("# Exported Source: author:demo") and len(bundle["history"]) == 1
    assert TOOLS["delete_source"].call(memory, source_id="author:filed") == {"source_id": "author:filed", "deleted": 1}
    assert TOOLS["get_collection_stats"].call(memory)["document_count"] == 2
    bad = [("search_documents", {"query": "a"}), ("search_documents", {"query": "ab", "limit": 51}), ("search_documents", {"query": "ab", "from_date": "2024"}), ("search_documents", {}), ("get_source_history", {"source_id": "author:demo", "limit": 201}), ("import_author_source", {"author_id": "demo"}), ("import_author_source", {"author_id": "De Mo", "file_content": "x"}), ("list_sources", {"x": 1}), ("search_documents", {"query": "ab", "limit": True})]
    for name, given in bad:
        with pytest.raises(InvalidInput):
            TOOLS[name].call(memory, **given)
    assert failure(NotFound("author:x"))[1]["code"] == "SOURCE_NOT_FOUND" and failure(NotFound("author:x:y"))[0] == 404 and failure(ValueError("x"))[0] == 400 and failure(KeyError("x"))[0] == 500


def test_http(memory):
    now = [1000.0]
    app = Application(memory, Settings.read({"FOLIOSCOPE_API_KEY": "k", "FOLIOSCOPE_RATE_LIMIT_RPM": "12"}), lambda: now[0])

    def ask(method, path, query="", body=None, key="k"):
        seen, raw = [], json.dumps(body).encode() if body else b""
        out = app({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "HTTP_AUTHORIZATION": f"Bearer {key}", "REMOTE_ADDR": "1", "CONTENT_LENGTH": str(len(raw)), "wsgi.input": io.BytesIO(raw)}, lambda s, h: seen.append((int(s[:3]), dict(h))))
        text = b"".join(out).decode()
        return *seen[0], json.loads(text) if text[:1] in "{[" and text else text

    assert ask("GET", "/health", key="")[0] == 200 and ask("GET", "/stats", key="no")[0] == 401 and ask("OPTIONS", "/stats")[0] == 204
    status, headers, found = ask("GET", "/search", "q=alpha&limit=5&explain=false")
    assert status == 200 and found["total"] == 1 and headers["X-Frame-Options"] == "DENY"
    assert ask("GET", "/search", "q=a")[0] == 400 and ask("GET", "/collection/sources/author:none")[0] == 404 and ask("GET", "/nowhere")[0] == 404
    assert ask("GET", "/collection/sources/author%3Ademo/status")[2]["documents"] == 2
    assert ask("POST", "/collection/import-author", body={"authorId": "web", "fileContent": "# W\nx"})[2]["added"] == 1 and ask("DELETE", "/collection/sources/author:web")[2]["deleted"] == 1
    assert ask("GET", "/health/ready")[0] == 200
    assert 'http_requests_total{status="200"}' in ask("GET", "/metrics")[2]
    for _ in range(12):
        last = ask("GET", "/health")
    assert last[0] == 429 and 0 < int(last[1]["Retry-After"]) <= 60
    now[0] += 61
    assert ask("GET", "/health")[0] == 200


def test_settings_and_providers():
    assert Settings.read({}).max_results == 20 and Settings.read({"FOLIOSCOPE_PORT": "80"}).port == 80
    for env in ({"FOLIOSCOPE_PORT": "0"}, {"FOLIOSCOPE_PORT": "x"}, {"FOLIOSCOPE_PORT": "65536"}, {"FOLIOSCOPE_ENGINE": "other"}):
        with pytest.raises(ValueError):
            Settings.read(env)
    assert providers.named("claude") == "claude-code" and providers.status("fake", {})["ready"] and not providers.status("openai", {})["ready"]
    assert "secret" not in str(providers.status("openai", {"OPENAI_API_KEY": "secret"})) and json.loads(providers.completer("fake")("hello"))["text"] == "fake:hello"
    for bad in (lambda: providers.named("other"), lambda: providers.local_url("http://example.org/x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):  # no answer is made up
        providers.completer("codex")
    assert providers.local_url("http://localhost:1/x") and providers.local_url("http://example.org", remote=True)
    told = providers.Diagnostics(last_error="sk-abcdefghijk failed", env={"OPENAI_API_KEY": "x"}).report()
    assert told["authenticated"] and "abcdefghijk" not in str(told)


def test_command_line(memory, spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("FOLIOSCOPE_ROOT", memory.root)
    assert main(["search-documents", "--query", "alpha", "--json"], spark) == 0 and json.loads(capsys.readouterr().out)["total"] == 1
    assert main(["get-source", "--source-id", "author:none"], spark) == 1 and "SOURCE_NOT_FOUND" in capsys.readouterr().err
    (tmp_path / "a.md").write_text("access_token=abc")
    assert main(["audit", str(tmp_path)], spark) == 1 and "token" in capsys.readouterr().out


def test_chat(spark, tmp_path):
    claims = spark.createDataFrame([("a", "claim-1", "grounded")], "author_id string, claim_id string, text string")
    people = spark.createDataFrame([("a",), ("b",)], "author_id string")
    folder = str(tmp_path / "chats")
    assert P.chat(spark, people, claims, "a", "hi", folder).first()["answer"] == "a: grounded"
    P.chat(spark, people, claims, "a", "again", folder, "session-a")
    P.chat(spark, people, claims, "b", "hi", folder)
    assert {r["session_id"]: r["turns"] for r in P.chat_history(spark, folder).collect()} == {"session-a": 2, "session-b": 1}
    for author, prompt, resume in (("c", "hi", None), ("a", "", None), ("a", "hi", "../x")):
        with pytest.raises(ValueError):
            P.chat(spark, people, claims, author, prompt, folder, resume)
    rows = spark.createDataFrame([("s", "b", " one  two "), (" ", "a", ""), ("s", "c", "x")], "source_id string, slug string, content string")
    assert [r["text"] for r in P.export_chunks(rows).collect()] == ["one two", "x"] and P.exported_texts(rows).where("source_id is null").count() == 1
    caveats = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "author_id string, caveats array<string>")
    assert [r["caveat"] for r in P.moderator_summary(caveats).orderBy("ord").collect()] == ["x", "y", "z"]
