"""The tools over HTTP, as a WSGI application."""

from __future__ import annotations

import hmac
import json
import re
import time
from collections.abc import Callable, Iterable
from http import HTTPStatus
from urllib.parse import parse_qsl, unquote

from ..operators.observability import Limiter
from ..service import DocumentMemory
from .settings import Settings
from .tools import TOOLS, InvalidInput, Requests, failure

# Headers of every answer, and paths that need no key.
HEADERS = {
    "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Authorization, Content-Type", "Vary": "Origin", "X-Content-Type-Options": "nosniff",
    "X-Frame-Options": "DENY", "Content-Security-Policy": "default-src 'none'", "Referrer-Policy": "no-referrer",
}
OPEN = ("/health", "/health/ready")
ONE = r"/collection/sources/(?P<source_id>[^/]+)"
ROUTES = [
    ("GET", "/search/?", "search_documents"), ("GET", "/search/compare", "compare_search_explain"), ("GET", "/stats", "get_collection_stats"), ("GET", "/llm/status", "get_llm_status"),
    ("GET", "/collection/sources", "list_sources"), ("GET", ONE, "get_source"), ("DELETE", ONE, "delete_source"), ("GET", f"{ONE}/status", "get_source_status"), ("GET", f"{ONE}/history", "get_source_history"),
    ("GET", f"{ONE}/export", "export_source"), ("POST", f"{ONE}/refresh", "refresh_source"), ("POST", f"{ONE}/memory/compact", "compact_source_memory"), ("POST", "/collection/import-author", "import_author_source"),
]
NAMES = {"q": "query", "fromDate": "from_date", "toDate": "to_date", "rankingMode": "mode", "dryRun": "dry_run", "includeHistory": "include_history", "filePath": "file_path", "fileContent": "file_content", "fileName": "file_name", "authorId": "author_id", "splitBy": "split_by", "tocKey": "toc_key"}
MOST_CLIENTS = 10_000


class Application:
    def __init__(self, memory: DocumentMemory, settings: Settings, clock: Callable[[], float] = time.time) -> None:
        self.memory, self.settings, self.clock = memory, settings, clock
        self.requests, self.clients = Requests(), {}

    def __call__(self, environ: dict, start: Callable) -> Iterable[bytes]:
        began = time.monotonic()
        headers = {"Access-Control-Allow-Origin": self.settings.cors_origin, **HEADERS}
        try:
            status, body, more = self.answer(environ)
        except Exception as e:
            (status, body), more = failure(e), {}
        text = body if isinstance(body, str) else "" if body is None else json.dumps(body, default=str)
        kind = "text/plain; version=0.0.4" if isinstance(body, str) else "application/json"
        start(f"{status} {HTTPStatus(status).phrase}", list((headers | {"Content-Type": kind} | more).items()))
        self.requests.add(status, time.monotonic() - began)
        return [text.encode()]

    def answer(self, environ: dict) -> tuple[int, object, dict]:
        method, path = environ["REQUEST_METHOD"], unquote(environ.get("PATH_INFO", "/"))
        if method == "OPTIONS":
            return 204, None, {}
        key = self.settings.api_key
        if key and path not in OPEN and not hmac.compare_digest(environ.get("HTTP_AUTHORIZATION", "").encode(), f"Bearer {key}".encode()):
            return 401, {"error": "Unauthorized"}, {"WWW-Authenticate": f'Bearer realm="{self.settings.name}"'}
        if wait := self.limited(environ.get("REMOTE_ADDR", "")):
            return 429, {"error": "Too many requests"}, {"Retry-After": str(wait)}
        if path == "/health":
            return 200, {"status": "ok"}, {}
        if path == "/health/ready":
            ready = self.memory.ready()
            return 200 if ready["ready"] else 503, ready, {}
        if path == "/metrics":
            return 200, self.requests.text(), {}
        for verb, pattern, name in ROUTES:
            if verb == method and (found := re.fullmatch(pattern, path)):
                return 200, TOOLS[name].call(self.memory, **self.given(environ, name), **found.groupdict()), {}
        return 404, {"error": f"no such path: {path}", "code": "NOT_FOUND"}, {}

    def limited(self, client: str) -> int:
        """Seconds to wait, 0 if the request may pass."""
        if client not in self.clients and len(self.clients) >= MOST_CLIENTS:
            now = int(self.clock() * 1e6)
            self.clients = {c: x for c, x in self.clients.items() if x.times and now - x.times[-1] < x.window}
        limiter = self.clients.setdefault(client, Limiter(limit=self.settings.rate_limit))
        return limiter.ask(int(self.clock() * 1e6))[1]

    def given(self, environ: dict, name: str) -> dict:
        out = {}
        for k, v in parse_qsl(environ.get("QUERY_STRING", ""), keep_blank_values=True):
            k = NAMES.get(k, k)
            kind = TOOLS[name].takes[k].kind if k in TOOLS[name].takes else str
            if kind is int and re.fullmatch(r"-?\d+", v):
                v = int(v)
            elif kind is bool and v in ("true", "false"):
                v = v == "true"
            out[k] = v
        if environ["REQUEST_METHOD"] == "POST" and (size := int(environ.get("CONTENT_LENGTH") or 0)):
            try:
                body = json.loads(environ["wsgi.input"].read(size))
            except ValueError:
                raise InvalidInput("the body is not JSON") from None
            if not isinstance(body, dict):
                raise InvalidInput("the body is no object")
            out |= {NAMES.get(k, k): v for k, v in body.items()}
        return out
