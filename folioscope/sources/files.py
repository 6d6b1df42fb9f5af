"""Files of the document store as DataFrames, and back. All reads go through Spark's readers, so that any
store that Spark reaches will do. Files of one document each are rows of (path, value) until they are parsed, and
every parser takes such rows from wherever they come; files of lines are split like any text. Texts that Spark writes
by the million are kept many to a file, as the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I

# Where texts are that have a file each: as people keep them, and as ``write_texts`` does.
POSTS, POST_PARTS = "{author}/posts/{slug}/post.md", "author_id={author}/document_slug={slug}/*.txt"
TRANSCRIPTS, TRANSCRIPT_PARTS = "{slug}/transcript.md", "slug={slug}/*.txt"
# Where they are many to a file, as ``write_bundles`` does, each with the path that it has in a file of its own.
POST_BUNDLES, TRANSCRIPT_BUNDLES = "author_id={author}/*.parquet", "*.parquet"
POST_KEYS = ("author_id", "document_slug", "slug", "title", "source_url", "published_at", "content_hash")


def whole(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, value) of each file that matches, of bundles of each text in them; none: no rows."""
    try:
        if pattern.endswith(".parquet"):
            return spark.read.schema("path string, value string").parquet(pattern)
        rows = spark.read.text(pattern, wholetext=True)
        return rows.select(F.col("_metadata.file_path").alias("path"), "value")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, value string")


def numbered_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, line, value) of each line of each file, the line numbers those of the file."""
    # A file may be read in many splits: a line's number is its place in the split, and the lines of those before.
    try:
        rows = spark.read.option("lineSep", "\n").text(pattern)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, line long, value string")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    splits = rows.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))  # a row for each split
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["path", "block"]).select("path", (F.col("n") + F.col("shift")).alias("line"), "value")


def write_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    """``rows(value)`` as text, a line each and a line end after the last; with ``by`` a folder for each of its values,
    lines in the order in which the rows stand."""
    rows = rows.select(*([by] if by else []), "value").write.mode("overwrite")
    (rows.partitionBy(by) if by else rows).text(path)


def write_texts(rows: DataFrame, folder: str, *by: str) -> None:
    """``rows(value, *by)`` as a file for each text, in folders named ``column=value``; rows that agree in ``by`` share a file, so
    they should not. Tasks write one file after another, however many there are; each takes a folder and a file, which the driver
    commits and lists, so corpora are for ``write_bundles``."""
    rows.select(*by, "value").repartition(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy(*by).text(folder)


def write_bundles(rows: DataFrame, folder: str, by: str | None = None) -> None:
    """``rows(path, value)`` as tables, many texts to a file in order of their paths; with ``by`` a folder for each of its values, of which a
    large one has many files and a task may write many small ones."""
    order = [*([by] if by else []), "path"]
    rows = rows.select(*order, "value").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    (rows.partitionBy(by) if by else rows).parquet(folder)


def read_posts(spark: SparkSession, folder: str, author: str = "*", layout: str = POSTS) -> DataFrame:
    """Posts of one or all authors under ``folder``; what can't be parsed is left out."""
    return parse_posts(whole(spark, f"{folder}/{layout.format(author=author, slug='*')}"))


def parse_posts(rows: DataFrame) -> DataFrame:
    """Posts of ``rows(value)``; what can't be parsed is left out."""
    end = F.instr("value", "\n---\n")
    head = F.try_parse_json(F.substring("value", F.lit(5), end - 5))
    body = F.regexp_replace(F.substring("value", end + 5, F.length("value")), r"^\s+|\s+$", "")
    rows = rows.where(end > 0).select(head.alias("h"), body.alias("content_markdown")).where("h is not null")
    get = lambda k: F.try_variant_get("h", f"$.{k}", "string")
    author, slug = F.coalesce(get("author_id"), F.lit("")), F.coalesce(get("document_slug"), F.lit(""))
    return rows.select(
        author.alias("author_id"), slug.alias("document_slug"), F.coalesce(get("slug"), T.author_slug(author, slug)).alias("slug"), F.coalesce(get("title"), slug).alias("title"),
        F.coalesce(get("source_url"), F.lit("")).alias("source_url"), F.nullif(get("published_at"), F.lit("")).alias("published_at"), T.strip_markdown(F.col("content_markdown")).alias("content_text"),
        "content_markdown", F.coalesce(get("content_hash"), T.short_hash(F.col("content_markdown"))).alias("content_hash"),
    )


def write_posts(posts: DataFrame, path: str) -> None:
    """Posts as a table, a folder for each author; authors that are not among them stay."""
    posts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("author_id").parquet(path)


def post_files(posts: DataFrame) -> DataFrame:
    """(path, value) of the posts as Markdown files with JSON front matter."""
    head = F.concat_ws(",\n", *(F.concat(F.lit(f'  "{k}": '), F.coalesce(F.to_json(F.array(k)), F.lit("[null]")).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2)) for k in POST_KEYS))
    value = F.concat(F.lit("---\n{\n"), head, F.lit("\n}\n---\n\n"), "content_markdown")
    return posts.select(F.concat_ws("/", "author_id", F.lit("posts"), "document_slug", F.lit("post.md")).alias("path"), value.alias("value"))


def front_matter(value):
    """(front matter, body) columns of a text: what stands between two lines of ``---`` at its start."""
    pattern = r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)"
    return F.regexp_extract(value, pattern, 1), F.regexp_replace(value, pattern, "")


def read_transcripts(spark: SparkSession, folder: str, layout: str = TRANSCRIPTS) -> DataFrame:
    """Records of the transcripts under ``folder``, each in a folder of its own."""
    return parse_transcripts(whole(spark, f"{folder}/{layout.format(slug='*')}"))


def parse_transcripts(rows: DataFrame) -> DataFrame:
    """Records of ``rows(path, value)``, slug that of the file's folder: flat ``key: value`` front matter and a body, of which the
    transcript begins after ``## Transcript``. Times become dates, texts of digits numbers; a file whose front matter
    doesn't end is an error that names its slug."""
    head, body = front_matter(F.col("value"))
    slug = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^slug=", "")
    broken = F.col("value").rlike(r"^---\r?\n") & ~F.col("value").rlike(r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)")
    slug = F.when(broken, F.raise_error(F.concat(F.lit("Failed to load document "), slug)).cast("string")).otherwise(slug)
    rows = rows.select(slug.alias("slug"), head.alias("head"), body.alias("content"))
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("head", rf"(?m)^{k}:[ \t]*(.*)$", 1), "^[\"']|[\"']\\s*$", "")), F.lit(""))
    block = F.regexp_extract("head", r"(?m)^keywords:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|$))+)", 1)
    inline = F.regexp_extract("head", r"(?m)^keywords:[ \t]*\[(.*)\]", 1)
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), "^-[ \t]+", ""), "^[\"']|[\"']$", ""))
    words = F.filter(F.transform(F.concat(F.split(block, "\n"), F.split(inline, ",")), lambda x: clean(x)), lambda x: x != "")
    at = F.instr("content", "## Transcript")
    transcript = F.regexp_replace(F.when(at > 0, F.substring("content", at + 13, F.length("content"))).otherwise(F.col("content")), r"^\s+|\s+$", "")
    texts = ("guest", "title", "youtube_url", "video_id", "publish_date", "description", "duration", "channel")
    numbers = ("duration_seconds", "view_count")
    dated = F.regexp_replace(field("publish_date"), r"^(\d{4}-\d{2}-\d{2})[T ].*$", "$1")
    out = rows.select("slug", *((dated if k == "publish_date" else field(k)).alias(k) for k in texts), *(field(k).try_cast("double").alias(k) for k in numbers), F.nullif(words, F.array().cast("array<string>")).alias("keywords"), "content", transcript.alias("transcript"))
    return out.withColumn("word_count", T.word_count(F.col("transcript")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw, v): each line that isn't blank as a variant; one that isn't JSON is an error that names its place."""
    rows = numbered_lines(spark, path).select("path", "line", F.trim("value").alias("raw")).where("raw <> ''")
    wrong = F.raise_error(F.concat(F.lit("Invalid JSON at "), "path", F.lit(":"), F.col("line").cast("string"))).cast("string")
    parsed = F.try_parse_json("raw")
    return rows.withColumn("checked", F.when(parsed.isNull(), wrong).otherwise(F.col("raw"))).select("path", "line", F.col("checked").alias("raw"), F.try_parse_json("checked").alias("v"))


def read_sections_jsonl(spark: SparkSession, path: str, toc_key: str) -> DataFrame:
    """Sections (id, ord, part, title, body) of files of JSON lines by what each line has under ``toc_key``, files and keys of any size; the id is
    the file's path. A line without a text under ``toc_key`` is an error that names its place."""
    get = lambda k: F.nullif(F.trim(F.try_variant_get("v", f"$.{k}", "string")), F.lit(""))
    raw = lambda k: F.when(get(k).isNotNull(), F.try_variant_get("v", f"$.{k}", "string"))
    place = F.concat(F.lit(f"no {toc_key} at "), "path", F.lit(":"), F.col("line").cast("string"))
    key = F.coalesce(raw(toc_key), F.raise_error(place).cast("string"))
    rows = read_jsonl(spark, path).select("path", "line", key.alias("key"), F.coalesce(raw("content"), raw("text"), F.lit("")).alias("text"))
    return I.sections_by_key(rows, "path", "line", "key", "text")


def read_document_jsonl(spark: SparkSession, path: str) -> DataFrame:
    get = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    rows = read_jsonl(spark, path)
    content = F.coalesce(get("content"), get("transcript"), F.lit(""))
    transcript = F.coalesce(get("transcript"), content)
    return rows.select(get("slug").alias("slug"), get("metadata.title").alias("title"), get("metadata.guest").alias("guest"), get("metadata.publish_date").alias("publish_date"), content.alias("content"), transcript.alias("transcript"), F.coalesce(get("wordCount", "bigint"), T.word_count(transcript)).alias("word_count"), T.short_hash(F.col("raw")).alias("content_hash"))


def read_category_jsonl(spark: SparkSession, path: str) -> DataFrame:
    get = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    content = F.coalesce(get("content"), F.lit(""))
    heading = F.nullif(F.trim(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return read_jsonl(spark, path).select(get("slug").alias("slug"), F.coalesce(get("name"), heading, get("slug")).alias("name"), content.alias("content"), F.coalesce(get("documentSlugs", "array<string>"), T.category_links(content)).alias("documentSlugs"), T.short_hash(F.col("raw")).alias("content_hash"))


def read_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of ``folder/*.md``, but for README.md and documents.md."""
    return parse_categories(whole(spark, f"{folder}/*.md"))


def parse_categories(rows: DataFrame) -> DataFrame:
    """Categories of ``rows(path, value)``, named by their first heading, else by their file."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    rows = rows.select(name.alias("slug"), "value").where("slug not in ('README', 'documents')")
    heading = F.nullif(F.trim(F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return rows.select("slug", F.coalesce(heading, F.col("slug")).alias("name"), F.col("value").alias("content"), T.category_links(F.col("value")).alias("documentSlugs"), T.short_hash(F.col("value")).alias("content_hash"))


def merge_by_slug(*parts: DataFrame) -> DataFrame:
    """Rows of several readers; a slug that stands twice is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    twice = out.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").orderBy("slug").limit(5).collect()
    if twice:
        raise ValueError(f"slugs that stand more than once: {[r['slug'] for r in twice]}")
    return out


def current_hashes(spark: SparkSession, transcripts: str, documents: str, posts: str) -> DataFrame:
    """(slug, hash) as the files are now; of a slug in several places the later place counts."""
    from ..operators.catalog import latest_wins

    own = whole(spark, f"{transcripts}/*/transcript.md").select(F.element_at(F.split("path", "/"), -2).alias("slug"), T.short_hash(F.col("value")).alias("hash"))
    lines = numbered_lines(spark, documents).select(F.trim("value").alias("raw")).where("raw <> ''").withColumn("v", F.try_parse_json("raw"))
    lines = lines.where("v is not null").select(F.try_variant_get("v", "$.slug", "string").alias("slug"), T.short_hash(F.col("raw")).alias("hash"))
    return latest_wins(own, lines, read_posts(spark, posts).select("slug", F.col("content_hash").alias("hash")))


def category_hashes(markdown: DataFrame, lines: DataFrame) -> DataFrame:
    """(slug, hash) of category files ``markdown(path, value)``, README and documents too, and of JSON ``lines(value)``;
    lines that aren't JSON are passed over, and of a slug in both the line counts."""
    from ..operators.catalog import latest_wins

    own = markdown.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("slug"), T.short_hash(F.col("value")).alias("hash"))
    said = lines.select(F.trim("value").alias("raw")).where("raw <> ''").withColumn("v", F.try_parse_json("raw")).where("v is not null")
    return latest_wins(own, said.select(F.try_variant_get("v", "$.slug", "string").alias("slug"), T.short_hash(F.col("raw")).alias("hash")))


def write_manifest(totals: DataFrame, path: str) -> None:
    """One row as JSON."""
    totals.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The totals of a manifest; none if it isn't there, isn't JSON or lacks a total: it has to be made again."""
    from ..operators.catalog import TOTALS

    try:
        rows = spark.read.schema(TOTALS).option("mode", "FAILFAST").json(path).collect()
    except Exception as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "MALFORMED_RECORD", "FAILED_READ_FILE")):
            raise
        return None
    if len(rows) != 1 or any(x is None for x in rows[0]):
        return None
    return spark.createDataFrame(rows, TOTALS)


def write_elements(rows: DataFrame, path: str) -> None:
    """Normalised elements as a table, a folder for each of 256 ranges of hashes of documents, in order of lines."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "line_start").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_elements(spark: SparkSession, path: str, doc_id=None) -> DataFrame:
    """Elements of all documents, or of one: its folder alone is read."""
    rows = spark.read.parquet(path)
    if doc_id is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id).cast(rows.schema["doc_id"].dataType)), F.lit(256)).cast("int")).first()[0]
        rows = rows.where((F.col("bucket") == bucket) & (F.col("doc_id") == doc_id))
    return rows.drop("bucket")


def write_vectors(rows: DataFrame, path: str) -> None:
    """``rows`` of the key of ``rerank.KEY`` and ``vector``, a folder for each first two characters of the slug's hash."""
    rows.withColumn("prefix", F.left(F.md5("slug"), F.lit(2))).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors, of a key that was stored more than once any one of them."""
    from ..operators.rerank import KEY

    return spark.read.parquet(path).drop("prefix").dropDuplicates(KEY)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, element rows) of the ``.md`` and ``.json`` files right in a folder; bad JSON is an error."""
    return parse_folder(whole(spark, f"{folder}/*.md"), whole(spark, f"{folder}/*.json"))


def parse_folder(markdown: DataFrame, documents: DataFrame) -> DataFrame:
    """Elements of ``(path, value)`` rows of Markdown and of JSON files."""
    from ..functions.jsontext import flatten

    def identified(rows: DataFrame) -> DataFrame:
        name = F.element_at(F.split("path", "/"), -1)
        return rows.withColumn("name", name).withColumn("doc_id", T.ingest_id(name, name, F.col("value")))

    md = I.elements(identified(markdown), "doc_id", "value", "name").withColumn("path", F.lit(None).cast("string"))
    raw = identified(documents)
    wrong = F.raise_error(F.concat(F.lit("Invalid JSON: "), "name")).cast("string")
    raw = raw.withColumn("value", F.when(F.try_parse_json("value").isNull(), wrong).otherwise(F.col("value")))
    flat = flatten(raw.withColumn("key", F.concat_ws("\n", "doc_id", "name")), "key", "value")
    part = F.split("id", "\n")
    rows = flat.select(part[0].alias("doc_id"), F.concat(part[0], F.lit(":e"), F.col("ord").cast("string")).alias("element_id"), F.lit("json").alias("kind"), "text", part[1].alias("source_file"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), "path")
    return md.unionByName(rows)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a log, in the order of its lines; no log: no rows."""
    return numbered_lines(spark, path).select("line", "value")


def event_line(source: str, action: str, at: str, documents: int) -> str:
    from ..operators.lifecycle import ACTIONS

    if action not in ACTIONS:
        raise ValueError(f"no such action: {action}")
    return json.dumps({"sourceId": source, "action": action, "documentCount": documents, "at": at}, separators=(",", ":"))


def inline(spark: SparkSession, text: str, name: str = "inline.md", toc_key: str | None = None, split_by: str | None = None) -> DataFrame:
    """Sections (id, ord, title, body) of a text that is handed over; of JSON lines by ``toc_key``."""
    if not name.endswith(".jsonl"):
        rows = spark.createDataFrame([(name, text)], "id string, text string")
        rows = I.sections_by(rows, "id", "text", split_by) if split_by else I.sections(rows, "id", "text")
        return I.distinct_titles(I.oversize(rows), "id", "ord", "part")
    if not toc_key:
        raise ValueError("JSON lines need the key that names their sections")
    lines = [(name, i, json.loads(x)) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    word = lambda r, k: r[k] if isinstance(r.get(k), str) and r[k].strip() else None
    if any(word(r, toc_key) is None for _, _, r in lines):
        raise ValueError(f"a record has no {toc_key}")
    rows = spark.createDataFrame([(n, i, word(r, toc_key), word(r, "content") or word(r, "text") or "") for n, i, r in lines], "id string, line int, key string, text string")
    found = I.group_by_key(rows, "id", "line", "key", "text").select(F.col("group").alias("id"), F.col("first_line").alias("ord"), F.col("key").alias("title"), "body")
    return I.distinct_titles(I.oversize(found), "id", "ord", "part")


def import_author(spark: SparkSession, author: str, text: str, name: str = "inline.md", toc_key: str | None = None, split_by: str | None = None) -> DataFrame:
    """The posts of an author's text."""
    from .paths import author_id

    author_id(author)
    return I.posts(inline(spark, text, name, toc_key, split_by).withColumn("author_id", F.lit(author)), name)
