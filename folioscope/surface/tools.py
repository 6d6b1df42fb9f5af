"""The tools over a document memory: what each takes, what it gives, and how that reads as text."""

from __future__ import annotations

import logging
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import export as E
from ..operators import search as S
from ..operators.lifecycle import HISTORY_CAP
from ..service import SECTIONS, DocumentMemory, NotFound
from .providers import Diagnostics

log = logging.getLogger(__name__)
# What inputs may be, and how slow a query is worth a warning.
DATE = r"\d{4}-\d{2}-\d{2}"
AUTHOR = r"[a-z0-9]+(?:-[a-z0-9]+)*"
DEFAULT_LIMIT = 10
SLOW_S = 0.5


class InvalidInput(ValueError):
    """An input that a tool doesn't take."""


@dataclass(frozen=True)
class Field:
    kind: type
    needed: bool = False
    least: int | None = None
    most: int | None = None
    shape: str | None = None
    choices: tuple = ()

    def check(self, name: str, value):
        sound = isinstance(value, self.kind) and not (self.kind is int and isinstance(value, bool))
        size = len(value) if sound and self.kind is str else value
        if sound and self.least is not None:
            sound = size >= self.least
        if sound and self.most is not None:
            sound = size <= self.most
        if sound and self.shape:
            sound = re.fullmatch(self.shape, value) is not None
        if sound and self.choices:
            sound = value in self.choices
        if not sound:
            raise InvalidInput(f"{name} is not what it has to be: {value!r}")
        return value


SOURCE = {"source_id": Field(str, True, 1)}
FILTERS = {"category": Field(str), "guest": Field(str), "from_date": Field(str, shape=DATE), "to_date": Field(str, shape=DATE)}
LIMIT = Field(int, least=1, most=S.PAGE_CAP)
PAGES = {"offset": Field(int, least=0), "limit": Field(int, least=1, most=1000)}


@dataclass(frozen=True)
class Tool:
    takes: dict[str, Field]
    run: Callable
    title: str
    needs: tuple = ()  # of these one at least

    def call(self, memory: DocumentMemory, **given) -> dict:
        if unknown := set(given) - set(self.takes):
            raise InvalidInput(f"no such input: {', '.join(sorted(unknown))}")
        if missing := [k for k, f in self.takes.items() if f.needed and given.get(k) is None]:
            raise InvalidInput(f"missing: {', '.join(missing)}")
        if self.needs and not any(given.get(k) for k in self.needs):
            raise InvalidInput(f"one of {', '.join(self.needs)} is needed")
        began = time.monotonic()
        out = self.run(memory, **{k: self.takes[k].check(k, v) for k, v in given.items() if v is not None})
        took = time.monotonic() - began
        log.log(logging.WARNING if took > SLOW_S else logging.DEBUG, "%s took %.3f s", self.title, took)
        return out


PAGE = 1000  # rows that one call returns, at most; the next call's offset is told


def rows(found: DataFrame) -> list[dict]:
    """Rows of a page, of a bounded number, as dictionaries."""
    return [r.asDict(True) for r in found.collect()]


def paged(name: str, found: DataFrame, *order: str, offset: int = 0, limit: int = PAGE) -> dict:
    """A page of ``found`` under ``name``; ``next_offset`` where there is more."""
    page = rows(found.orderBy(*order).offset(offset).limit(limit + 1))
    return {name: page[:limit], **({"next_offset": offset + limit} if len(page) > limit else {})}


def search_documents(memory: DocumentMemory, query: str, rerank: bool = True, explain: bool = False, **options) -> dict:
    wanted = S.Search(query, **({"limit": DEFAULT_LIMIT} | options))
    source, categories = memory.source_of_searches(), memory.table("bridge")
    reranker = memory.reranker(query) if rerank and memory.reranker else None
    out = {"results": rows(S.search(source, wanted, categories, reranker).orderBy("rank")), "total": S.total(source, wanted, categories).first()[0], **S.reported_paging(wanted)}
    if explain:
        out["signals"] = rows(S.explain(source, wanted, categories).orderBy("rank", "field"))
    return out


def compare_search_explain(memory: DocumentMemory, query: str, **options) -> dict:
    found = rows(memory.compare(query, **({"limit": DEFAULT_LIMIT} | options)).orderBy(F.asc_nulls_last("weighted_rank"), F.asc_nulls_last("rrf_rank")))
    top = lambda k: next((r["slug"] for r in found if r[k] == 1), None)
    return {"overlap": sum(r["in_both"] for r in found), "weighted_top": top("weighted_rank"), "rrf_top": top("rrf_rank"), "results": found}


def export_source(memory: DocumentMemory, source_id: str, format: str = "json", include_history: bool = False, offset: int = 0, limit: int = PAGE) -> dict:
    """The whole export as files under ``path``, JSON lines or Markdown; a page of its documents, and Markdown that fits a page, in the answer too."""
    documents, manifest = memory.export(source_id, include_history)
    path = f"{memory.root}/exports/{source_id.replace(':', '-')}-{uuid.uuid4().hex[:12]}"
    manifest.write.json(f"{path}/manifest")
    text = E.export_markdown(documents, manifest)
    if format == "markdown":
        text.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("text").write.text(f"{path}/markdown")
    else:
        documents.repartitionByRange("slug").sortWithinPartitions("slug").write.json(f"{path}/documents")
    out = {"manifest": manifest.first().asDict(), "path": path, **paged("documents", documents, "slug", offset=offset, limit=limit)}
    if include_history:
        history = memory.history(source_id, limit=HISTORY_CAP)
        out["history"] = rows(history)  # HISTORY_CAP events; get_source_history has all, page by page
    if format == "markdown" and "next_offset" not in out and not offset:
        out["markdown"] = "\n".join(r["text"] for r in text.orderBy("part", "ord").collect())
    return out


def import_author_source(memory: DocumentMemory, author_id: str, file_path: str | None = None, file_content: str | None = None, file_name: str = "inline.md", split_by: str | None = None, toc_key: str | None = None) -> dict:
    if file_path:
        if not memory.imports:
            raise InvalidInput("no folder to import from")
        changes = memory.import_file(author_id, memory.imports, file_path, toc_key=toc_key, split_by=split_by)
    else:
        changes = memory.import_author(author_id, file_content, file_name, toc_key, split_by=split_by)
    counts = {r["action"]: r["count"] for r in changes.groupBy("action").count().collect()}
    return {"source_id": f"author:{author_id}", **{a: counts.get(a, 0) for a in ("added", "updated", "skipped")}, **paged("changes", changes, "slug")}


def _page(memory: DocumentMemory, source_id: str, **options) -> dict:
    return {"events": rows(memory.history(source_id, **options).orderBy("line")), "offset": options.get("offset", 0), "limit": options.get("limit", 100)}


def _status(memory: DocumentMemory, source_id: str) -> dict:
    memory.source(source_id)
    found = memory.status(source_id).first()
    return {"source_id": source_id, "documents": memory.source(source_id).count(), **(found.asDict() if found else {"interaction_count": 0})}


TOOLS = {
    "search_documents": Tool({"query": Field(str, True, 2), "limit": LIMIT, "offset": Field(int, least=0), "page": Field(int, least=1), **FILTERS, "rerank": Field(bool), "mode": Field(str, choices=("weighted", "rrf")), "explain": Field(bool)}, search_documents, "Results"),
    "compare_search_explain": Tool({"query": Field(str, True, 2), "limit": LIMIT, **FILTERS}, compare_search_explain, "Rankings"),
    "get_document": Tool({"slug": Field(str), "guest": Field(str), "section": Field(str, choices=SECTIONS)}, lambda m, slug=None, guest=None, section="metadata": {"slug": slug, "section": section, "content": m.document(slug, section, guest)}, "Document"),
    "get_collection_stats": Tool({}, lambda m: m.stats(), "Collection"),
    "get_llm_status": Tool({}, lambda m: (m.diagnostics or Diagnostics()).report(), "Model provider"),
    "list_sources": Tool(PAGES, lambda m, **page: paged("sources", m.sources(), "source_id", **page), "Sources"),
    "get_source": Tool(SOURCE | PAGES, lambda m, source_id, **page: {"source_id": source_id, **paged("documents", m.source(source_id), "slug", **page)}, "Source"),
    "get_source_status": Tool(SOURCE, _status, "Source status"),
    "get_source_history": Tool(SOURCE | {"offset": Field(int, least=0), "limit": Field(int, least=0, most=200)}, _page, "Source history"),
    "refresh_source": Tool(SOURCE | {"dry_run": Field(bool)}, lambda m, source_id, dry_run=False: m.refresh(source_id, dry_run), "Refresh"),
    "compact_source_memory": Tool(SOURCE, lambda m, source_id: m.compact(source_id), "Compaction"),
    "export_source": Tool(SOURCE | PAGES | {"format": Field(str, choices=("json", "markdown")), "include_history": Field(bool)}, export_source, "Export"),
    "delete_source": Tool(SOURCE, lambda m, source_id: {"source_id": source_id, "deleted": m.delete(source_id)}, "Deletion"),
    "import_author_source": Tool({"file_path": Field(str, least=1), "file_content": Field(str, least=1), "file_name": Field(str, least=1), "author_id": Field(str, True, shape=AUTHOR), "split_by": Field(str, least=1), "toc_key": Field(str, least=1)}, import_author_source, "Import", ("file_path", "file_content")),
}


def render(name: str, found: dict, most: int = 50_000) -> str:
    """What a tool gave, as text: its values as a list, each of its rows under a heading of its own."""
    lines = [f"# {TOOLS[name].title}", ""]
    lists = {k: v for k, v in found.items() if isinstance(v, list)}
    lines += [f"- {k.replace('_', ' ')}: {v}" for k, v in found.items() if k not in lists and not isinstance(v, dict) and v is not None and k not in ("content", "markdown")]
    for v in (x for x in found.values() if isinstance(x, dict)):
        lines += [f"- {k.replace('_', ' ')}: {x}" for k, x in v.items() if x is not None]
    for said, each in lists.items():
        lines += ["", f"## {said.replace('_', ' ').capitalize()}", ""] + ([] if each else ["Nothing found."])
        for i, row in enumerate(each, 1):
            head = row.get("title") or row.get("slug") or row.get("source_id") or str(i)
            lines += [f"### {i}. {head}", *(f"- {k.replace('_', ' ')}: {x}" for k, x in row.items() if x is not None and x != head), ""]
    lines += ["", *(found[k] for k in ("content", "markdown") if found.get(k))]
    text = "\n".join(lines)
    return text if len(text) <= most else text[:most] + "\n\n...(truncated)"


def failure(error: Exception) -> tuple[int, dict]:
    """(status, body) of what went wrong: 404 for what isn't there, 400 for what was asked wrongly, else 500."""
    if isinstance(error, NotFound):
        text = str(error)
        return 404, {"error": f"not found: {text}", "code": "SOURCE_NOT_FOUND" if re.fullmatch(r"author:[^:]+", text) else "DOCUMENT_NOT_FOUND"}
    if isinstance(error, ValueError):
        return 400, {"error": str(error), "code": "INVALID_INPUT"}
    return 500, {"error": type(error).__name__, "code": "INTERNAL"}


@dataclass
class Requests:
    """Counts of requests and how long they took, in the buckets of ``observability.BOUNDS``."""

    by_status: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=dict)
    seconds: float = 0.0

    def add(self, status: int, seconds: float) -> None:
        from ..operators.observability import BOUNDS

        self.by_status[status] = self.by_status.get(status, 0) + 1
        self.seconds += seconds
        for bound in BOUNDS:
            self.buckets[bound] = self.buckets.get(bound, 0) + (seconds <= bound)

    def text(self) -> str:
        from ..operators.observability import BOUNDS

        total, name = sum(self.by_status.values()), "http_request_duration_seconds"
        lines = ["# TYPE http_requests_total counter", *(f'http_requests_total{{status="{s}"}} {n}' for s, n in sorted(self.by_status.items()) or [("none", 0)])]
        lines += ["# TYPE http_request_errors_total counter", f"http_request_errors_total {sum(n for s, n in self.by_status.items() if s >= 400)}", f"# TYPE {name} histogram"]
        lines += [f'{name}_bucket{{le="{b:g}"}} {self.buckets.get(b, 0)}' for b in BOUNDS] + [f'{name}_bucket{{le="+Inf"}} {total}', f"{name}_sum {self.seconds:.6f}", f"{name}_count {total}"]
        return "\n".join(lines) + "\n"
