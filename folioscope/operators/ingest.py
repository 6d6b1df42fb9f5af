"""From raw texts to sections, posts, elements and chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..workers import importable
from .ranges import with_sum_before

OVERSIZE = 8000
SECTION = "ord int, title string, body string"


def sections(df: DataFrame, id_col: str, text_col: str, heading: str = r"^#{1,3}[ \t]+(\S.*)$") -> DataFrame:
    """(id, ord, title, body): a text cut at its headings, a body with its heading line.

    What stands before the first heading is left out; a text without one is a single section
    "Untitled". Each text is cut by itself inside its row, so nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.regexp_replace(text, f"(?m){heading}", "\u0001$0")
    parts = F.split(marked, "\u0001")
    body = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    title = lambda x: F.trim(F.regexp_replace(F.element_at(F.split(x, "\n"), 1), r"^#{1,6}\s+", ""))
    found = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x, i: F.struct((i + 1).alias("ord"), title(x).alias("title"), body(x).alias("body")))
    alone = F.array(F.struct(F.lit(1).alias("ord"), F.lit("Untitled").alias("title"), body(text).alias("body")))
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.when(F.size(parts) > 1, found).otherwise(alone)).alias("s"))
    return rows.select("id", "s.ord", "s.title", "s.body")


def cut_by(text: str | None, rule: re.Pattern) -> list[tuple]:
    """(ord, title, body) of one text, cut where ``rule`` matches."""
    text = text or ""
    found = list(rule.finditer(text))
    if not found:
        return [(1, "Untitled", text.strip())]
    ends = [m.start() for m in found[1:]] + [len(text)]
    title = lambda m: re.sub(r"^#{1,6}\s+", "", (m.group(1) if rule.groups and m.group(1) is not None else m.group(0)) or "").strip()
    return [(i, title(m), text[m.start() : e].strip()) for i, (m, e) in enumerate(zip(found, ends, strict=True), 1)]


def sections_by(df: DataFrame, id_col: str, text_col: str, split_by: str) -> DataFrame:
    """``sections`` for a pattern of the caller's: the title is its first group, else the match."""
    rule = re.compile(split_by, re.MULTILINE)
    importable(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [cut_by(t, rule) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, g in enumerate(got) for _ in g], pa.int64())
            flat = [s for g in got for s in g]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.string()), pa.array([s[2] for s in flat], pa.string())], ["id", "ord", "title", "body"])

    return rows.mapInArrow(run, f"id {kind}, {SECTION}")


def oversize(df: DataFrame, size: int = OVERSIZE) -> DataFrame:
    """Sections of more than ``size`` words as pieces of so many, joined by blanks: (id, ord, part,
    title, body), the later ones titled "T 2", "T 3", ..."""
    words = T.pieces(F.col("body"))
    n = F.size(words)
    part = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda a, i: F.struct((i + 1).alias("part"), F.when(i == 0, F.col("title")).otherwise(F.concat_ws(" ", F.col("title"), (i + 1).cast("string"))).alias("title"), F.array_join(F.slice(words, a + 1, F.lit(size)), " ").alias("body")))
    whole = F.array(F.struct(F.lit(1).alias("part"), F.col("title"), F.col("body")))
    rows = df.select("id", "ord", F.explode(F.when(n > size, part).otherwise(whole)).alias("s"))
    return rows.select("id", "ord", "s.part", "s.title", "s.body")


def distinct_titles(df: DataFrame, group: str, *order: str) -> DataFrame:
    """The n-th section of a group with a title that makes the same slug is called "T n"."""
    nth = F.row_number().over(Window.partitionBy(group, T.slugify(F.col("title"))).orderBy(*order))
    return df.withColumn("nth", nth).withColumn("title", F.when(F.col("nth") == 1, F.col("title")).otherwise(F.concat_ws(" ", "title", F.col("nth").cast("string")))).drop("nth")


def group_by_key(df: DataFrame, group: str, line: str, key: str, text: str) -> DataFrame:
    """(group, key, first_line, body): records of one key as a section, parts in line order, under a heading."""
    order = F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    rows = df.groupBy(F.col(group).alias("group"), F.col(key).alias("key")).agg(F.min(line).alias("first_line"), order.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["t"]), "\n")
    body = F.concat(F.lit("# "), F.col("key"), F.lit("\n\n"), joined)
    return rows.select("group", "key", "first_line", F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def sections_by_key(df: DataFrame, group: str, line: str, key: str, text: str, size: int = OVERSIZE) -> DataFrame:
    """``oversize`` of the sections of ``group_by_key``, for keys with any number of records: (id, ord, part, title, body).

    A record's place in its key is a difference of sums over ranges of all records, and each record is cut where parts end, so what is
    gathered is a part: ``size`` words at most, besides records without words. Records that agree in ``line`` are ordered by
    their text, null texts are empty, records without a key have no section. No records: no rows.
    """
    words, head = T.pieces(F.col("text")), T.pieces(F.concat(F.lit("# "), F.col("key")))
    rows = df.where(F.col(key).isNotNull()).select(F.col(group).alias("id"), F.col(key).alias("key"), F.col(line).alias("line"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = with_sum_before(rows.withColumn("n", F.size(words)), [F.col(c) for c in ("id", "key", "line", "text")], "n")
    keys = placed.groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.min("line").alias("ord"), F.min("before").alias("start"), (F.sum("n") + F.size(F.first(head))).alias("total"))
    at = F.col("before") - F.col("start") + F.size(head)
    placed = placed.join(keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).withColumn("at", at)
    large = F.col("total") > size
    last = F.floor((F.col("at") + F.col("n") - 1) / size)
    parts = F.when(large, F.when(F.col("n") > 0, F.sequence(F.floor(F.col("at") / size), last))).otherwise(F.array(F.lit(0).cast("long")))
    each = placed.select("id", "key", "ord", "total", "line", "text", "at", F.explode(parts).alias("nth"))
    begin = F.greatest(F.col("nth") * size - F.col("at"), F.lit(0))
    own = F.slice(words, (begin + 1).cast("int"), (F.least((F.col("nth") + 1) * size - F.col("at"), F.size(words)) - begin).cast("int"))
    piece = F.when(large, F.array_join(own, " ")).otherwise(F.col("text"))
    each = each.select("id", "key", "ord", "total", "nth", F.struct("at", "line", piece.alias("t")).alias("p"))
    tops = F.transform(F.sequence(F.lit(0), F.size(head) - 1, F.lit(size)), lambda a: F.struct(F.floor(a / size).alias("nth"), F.array_join(F.slice(head, a + 1, F.lit(size)), " ").alias("t")))
    tops = keys.where(large).select(F.col("i").alias("id"), F.col("k").alias("key"), "ord", "total").select("id", "key", "ord", "total", F.explode(tops).alias("h"))
    nothing = F.lit(None).cast(df.schema[line].dataType)
    tops = tops.select("id", "key", "ord", "total", "h.nth", F.struct(F.lit(-1).cast("long").alias("at"), nothing.alias("line"), F.col("h.t").alias("t")).alias("p"))
    texts = F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"])
    found = each.unionByName(tops).groupBy("id", "key", "ord", "total", "nth").agg(texts.alias("texts"))
    small = F.regexp_replace(F.concat(F.lit("# "), F.col("key"), F.lit("\n\n"), F.array_join("texts", "\n")), r"^\s+|\s+$", "")
    body = F.when(large, F.array_join("texts", " ")).otherwise(small)
    title = F.when(F.col("nth") == 0, F.col("key")).otherwise(F.concat_ws(" ", "key", (F.col("nth") + 1).cast("string")))
    return found.select("id", "ord", (F.col("nth") + 1).cast("int").alias("part"), title.alias("title"), body.alias("body"))


def posts(df: DataFrame, source_url: str = "inline.md") -> DataFrame:
    """``df(author_id, title, body)`` as posts."""
    slug = T.slugify(F.col("title"))
    return df.select(
        "author_id", slug.alias("document_slug"), T.author_slug(F.col("author_id"), slug).alias("slug"), "title", F.lit(source_url).alias("source_url"),
        F.lit(None).cast("string").alias("published_at"), T.strip_markdown(F.col("body")).alias("content_text"), F.col("body").alias("content_markdown"),
        T.post_hash(F.col("author_id"), F.col("title"), F.col("body")).alias("content_hash"),
    )


def documents_of(rows: DataFrame) -> DataFrame:
    """Posts as document records."""
    return rows.select(
        "slug", F.col("document_slug"), "author_id", F.lit("author").alias("source"), "title", F.col("author_id").alias("guest"), F.array().cast("array<string>").alias("keywords"),
        F.col("published_at").alias("publish_date"), F.col("source_url").alias("original_url"), F.col("content_markdown").alias("content"), F.col("content_text").alias("transcript"),
        T.word_count(F.col("content_text")).alias("word_count"), "content_hash",
    )


def elements(df: DataFrame, id_col: str, text_col: str, file_col: str | None = None) -> DataFrame:
    """(doc_id, element_id, kind, text, source_file, line_start, line_end): a text's lines by kind.

    A fence turns code on or off and is code itself; then headings, list items, table rows and
    paragraphs. Blank lines, also in code, are no elements; elements are numbered without them. All of
    it happens inside the row, so a text's lines need no window: what lies between fences is a string of marks, one a
    line, and every second string stands for code.
    """
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")
    numbered = F.filter(F.transform(raw, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("bare"))), lambda x: x["bare"] != "")
    rows = df.select(F.col(id_col).alias("doc_id"), (F.col(file_col) if file_col else F.lit(None).cast("string")).alias("source_file"), numbered.alias("rows"))
    marks = F.array_join(F.transform("rows", lambda x: F.when(x["bare"].startswith("```"), "f").otherwise("-")), "")
    between = F.transform(F.split(marks, "f"), lambda x, k: F.when(k % 2 == 1, F.translate(x, "-", "c")).otherwise(x))
    rows = rows.withColumn("marks", F.split(F.array_join(between, "f"), ""))
    marked = F.transform("rows", lambda x, i: F.struct(F.get("marks", i).alias("mark"), x["line"].alias("line"), x["text"].alias("text"), x["bare"].alias("bare")))
    each = rows.select("doc_id", "source_file", F.posexplode(marked).alias("i", "r"))
    bare = F.col("r.bare")
    kind = F.when(F.col("r.mark") != "-", "code").when(bare.startswith("#"), "heading").when(bare.rlike(r"^[-*]\s+"), "list").when(bare.contains("|"), "table").otherwise("paragraph")
    return each.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":e"), F.col("i") + 1).alias("element_id"), kind.alias("kind"), F.col("r.text").alias("text"), "source_file", F.col("r.line").alias("line_start"), F.col("r.line").alias("line_end"))


def chunks(rows: DataFrame, *order: str) -> DataFrame:
    """Elements with text as chunks, numbered over all documents in order of ``doc_id``.

    The number is an element's place in its document and the elements of the documents before, which are summed
    over the documents' counts; the elements themselves are only ordered within their document.
    """
    kept = rows.where(F.trim("text") != "")
    inner = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    counts = kept.groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("n"))
    starts = with_sum_before(counts, [F.col("d")], "n")
    numbered = kept.withColumn("inner", inner).join(starts.select("d", "before"), F.col("doc_id") == F.col("d"))
    return numbered.select("doc_id", "element_id", F.concat("element_id", F.lit(":c"), (F.col("before") + F.col("inner")).cast("string")).alias("chunk_id"), "text", "source_file", "line_start", "line_end")


def author_jsonl(rows: DataFrame, author_id: str) -> DataFrame:
    """Elements as lines of an author import; no elements are an error."""
    if rows.isEmpty():
        raise ValueError("no elements to import")
    meta = F.struct("element_id", "kind", "line_start", "line_end")
    return rows.select(F.to_json(F.struct(F.lit(author_id).alias("authorId"), F.col("doc_id").alias("tocKey"), F.col("source_file").alias("title"), F.col("text").alias("content"), meta.alias("metadata"))).alias("value"))
