"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Words of the lower-cased text in order: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def searchable(*fields: Column) -> Column:
    """Fields laid under each other, lower-cased; empty ones leave their line empty."""
    return F.lower(F.concat_ws("\n", *(F.coalesce(f, F.lit("")) for f in fields)))


def pieces(c: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(pieces(F.coalesce(c, F.lit("")))).cast("long")


def slugify(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("untitled"))


def keyword_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_markdown(c: Column) -> Column:
    """Text without a leading front matter and heading marks, white space collapsed."""
    body = F.regexp_replace(c, r"^---[\s\S]*?---\s*", "")
    return collapse(F.regexp_replace(body, r"(?m)^#{1,6}\s+", ""))


def short_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def post_hash(author: Column, title: Column, markdown: Column) -> Column:
    return short_hash(F.concat_ws("\n", author, title, markdown))


def ingest_id(name: Column, path: Column, text: Column) -> Column:
    """File name with odd characters dashed, and 12 digits of a hash of path and text."""
    digest = F.left(F.sha1(F.concat_ws("\n", path, text)), F.lit(12))
    return F.concat_ws("-", F.regexp_replace(name, "[^a-zA-Z0-9가-힣_-]+", "-"), digest)


def byte_length(c: Column) -> Column:
    return F.octet_length(F.coalesce(c, F.lit(""))).cast("long")


def round2(c: Column) -> Column:
    """Halves go up, on the double itself (not on its shortest decimal form)."""
    return F.floor(c * 100 + 0.5) / 100


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def first_lines(c: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(c), 1, n), "\n")


def metadata_section(c: Column, marker: str = "## Transcript") -> Column:
    """Lines before the first that begins with the marker, trimmed; without one, the first 50 lines."""
    at = F.array_position(F.transform(lines(c), lambda x: x.startswith(marker)), True).cast("int")
    return F.when(at > 0, F.trim(F.array_join(F.slice(lines(c), F.lit(1), at - 1), "\n"))).otherwise(first_lines(c, 50))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("\n\n...(truncated)"))).otherwise(c)


def marked_snippet(c: Column, around: int = 160) -> Column:
    """What stands near the first ``<mark>`` of a text that a search server marked; without one its beginning."""
    at = F.instr(c, "<mark>") - 1
    start = F.greatest(F.lit(0), at - around // 2)
    end = F.least(F.length(c), at + around // 2 + len("<mark>") + 50)
    return F.trim(F.when(at < 0, F.left(c, F.lit(around))).otherwise(F.substring(c, start + 1, end - start)))


def category_links(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\]\(\.\./documents/([^/)]+)/transcript\.md\)"), F.lit(1))))


def author_slug(author: Column, slug: Column) -> Column:
    return F.concat_ws(":", F.lit("author"), author, slug)


def slug_author(slug: Column) -> Column:
    """The author of ``author:a:b``; null unless there are three parts, none empty."""
    parts = F.split(slug, ":")
    sound = (F.size(parts) == 3) & (parts[0] == "author") & F.forall(parts, lambda x: x != "")
    return F.when(sound, parts[1])


def source_id(author: Column, slug: Column) -> Column:
    """``author:`` and the author, else the slug's second part, else unknown."""
    return F.concat(F.lit("author:"), F.coalesce(author, F.get(F.split(slug, ":"), F.lit(1)), F.lit("unknown")))


def bounded(term: str) -> str:
    """A pattern for a term that stands by itself, by ASCII word characters on both dialects."""
    before = "(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", term[:1]) else "(?<=[A-Za-z0-9_])"
    after = "(?![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", term[-1:]) else "(?=[A-Za-z0-9_])"
    return before + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term) + after


# The forms in which secrets appear, what is put in their place, and paths that may not be tracked.
SECRET_FORMS = {
    "key": r"sk-[A-Za-z0-9_-]{20,}",
    "header": r"(?i)Authorization:\s*Bearer\s+\S+",
    "token": r"(?i)(access_token|refresh_token)=\S+",
    "openai": r"(^|\s)OPENAI_API_KEY\s*=\s*[^<\s]+",
    "kimi": r"(^|\s)KIMI_API_KEY\s*=\s*[^<\s]+",
    "codex": r"(^|\s)CODEX_AUTH\s*=\s*[^<\s]+",
    "oauth": r"(^|\s)CLAUDE_CODE_OAUTH\s*=\s*[^<\s]+",
}
REDACTIONS = [
    (r"(?i)Authorization:\s*Bearer\s+\S+", "Authorization: Bearer <redacted>"),
    (r"sk-[A-Za-z0-9_-]{8,}", "<redacted>"),
    (r"(?i)(access_token|refresh_token)=([^\s]+)", "$1=<redacted>"),
    (r"(OPENAI_API_KEY|KIMI_API_KEY|CODEX_AUTH|CLAUDE_CODE_OAUTH)\s*=\s*([^\s]+)", "$1=<redacted>"),
    (r"//([^:\s]+):([^@\s]+)@", "//<redacted>:<redacted>@"),
]


FORBIDDEN_PATHS = r"^(evidence/(?!\.gitkeep)|normalized/|raw/|chunks/|generated-personas/|debate-transcripts/|eval4sim-reports/|model-cache/|\.env)"
UNSCANNED = (".png", ".lock")


def redact(c: Column) -> Column:
    for form, put in REDACTIONS:
        c = F.regexp_replace(c, form, put)
    return c


def secret_kinds(c: Column) -> Column:
    """Names of the forms that a text holds."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in SECRET_FORMS.items())))


def audit_files(rows):
    """(path, problem) of ``rows(path, value)``: paths that may not be tracked, and texts with secrets in them."""
    skipped = F.col("path").endswith(UNSCANNED[0]) | F.col("path").endswith(UNSCANNED[1])
    found = F.concat(F.when(F.col("path").rlike(FORBIDDEN_PATHS), F.array(F.lit("forbidden path"))).otherwise(F.array().cast("array<string>")), F.when(~skipped, secret_kinds(F.col("value"))).otherwise(F.array().cast("array<string>")))
    return rows.select("path", F.explode(found).alias("problem"))


def safe_category(c: Column) -> Column:
    """A category as a slug; null if it could leave its folder or is empty."""
    bad = c.rlike(r"\.\.|[/\\\p{Cc}]")
    return F.when(~bad, F.nullif(F.regexp_replace(F.trim(c), r"\s+", "-"), F.lit("")))
