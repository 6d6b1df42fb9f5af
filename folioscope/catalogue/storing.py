"""What is written and read back: posts, transcripts, JSON lines, categories, logs, elements, manifests, vectors, persona files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import jsontext as J
from ..functions import text as T
from ..operators import catalog as K
from ..operators import clones as L
from ..operators import ingest as I
from ..operators import lifecycle as E
from ..operators import persona as P
from ..operators import rerank as R
from ..plans import corpus as C
from ..service import DocumentMemory
from ..sources import files
from .prelude import AUTHOR, BRIDGE, EVENTS, REC

EDITED = "src03"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_folder(spark)}/folioscope-{name}-{uuid.uuid4().hex[:8]}"


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.records(spark, sf_dir).select("author_id", F.concat_ws(" ", "title", F.col("doc_id").cast("string")).alias("title"), F.col("content").alias("body"))
    return I.posts(rows, "import.md")


def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as a table; one author's are written anew, the others stay as they were."""
    path = _folder(spark, "posts")
    posts = _posts(spark, sf_dir)
    files.write_posts(posts, path)
    files.write_posts(posts.where(F.col("author_id") == EDITED).withColumn("content_markdown", F.concat("content_markdown", F.lit("\nEdited."))), path)
    rows = I.documents_of(spark.read.schema(posts.schema).parquet(path))
    return rows.select("slug", "guest", "title", "original_url", T.short_hash(F.col("content")).alias("file_hash"), "content_hash", "word_count")


def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as files with front matter, and back; a file that can't be parsed is left out."""
    rows = files.post_files(_posts(spark, sf_dir))
    bad = rows.select(F.concat("path", F.lit(".bad")).alias("path"), F.lit("---\n{broken\n---\nbody").alias("value"))
    back = files.parse_posts(rows.unionByName(bad))
    return back.select("author_id", "document_slug", "slug", "title", "source_url", "published_at", "content_hash", F.sha2("content_markdown", 256).alias("body_hash"))


def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with front matter of texts, dates, numbers and lists."""
    docs = C.records(spark, sf_dir)
    head = F.concat(F.lit("---\nguest: \""), "guest", F.lit("\"\npublish_date: "), "publish_date", F.when(F.col("doc_id") % 2 == 0, "T10:00:00.000Z").otherwise(""), F.lit("\nview_count: '"), F.col("doc_id").cast("string"), F.lit("'\nduration:\nkeywords:\n  - "), F.coalesce("lang", F.lit("none")), F.lit("\n  - two words\n---\n"))
    body = F.when(F.col("doc_id") % 3 == 0, F.lit("About.\n\n## Transcript\n\n")).otherwise("")
    rows = docs.select(F.concat(F.lit("documents/"), "slug", F.lit("/transcript.md")).alias("path"), F.concat(head, body, F.lit("x "), F.col("content"), F.lit(" y")).alias("value"))
    back = files.parse_transcripts(rows)
    return back.select("slug", "guest", "publish_date", F.col("view_count").cast("long").alias("views"), "duration", F.array_join("keywords", ",").alias("keywords"), F.sha2("transcript", 256).alias("transcript_hash"), "word_count")


def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records as JSON lines, written and read with the hash of each line; a line between is blank."""
    docs = C.records(spark, sf_dir)
    m = F.md5("content")
    line = F.concat(F.lit('{"slug":"'), "slug", F.lit('","metadata":{"title":"'), m, F.lit('"},"'), F.when(F.col("doc_id") % 2 == 0, "content").otherwise("transcript"), F.lit('":"a '), m, F.lit(' b"}'))
    path = _folder(spark, "jsonl")
    files.write_lines(docs.select(F.explode(F.array(F.concat(F.lit(" "), line), F.lit(" "))).alias("value")), path)
    return files.read_document_jsonl(spark, path).select("slug", "title", "content", "transcript", "word_count", "content_hash")


def _category_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, links, docs): categories, each in sixteen parts by hash of the document."""
    pairs = C.bridge(spark, sf_dir).withColumn("part", F.left(F.md5("slug"), F.lit(1)))
    slugs = F.array_sort(F.collect_list("slug"))
    return pairs.groupBy(F.concat_ws("-", "category_slug", "part").alias("slug")).agg(slugs.alias("docs"))


def _category_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _category_rows(spark, sf_dir)
    line = lambda x: F.concat(F.lit("- [t](../documents/"), x, F.lit("/transcript.md)"))
    text = F.concat(F.lit("# Name of "), "slug", F.lit("\n\n"), F.array_join(F.transform("docs", line), "\n"), F.lit("\n"))
    md = rows.where("slug not like 'toxic%'").select(F.concat(F.lit("categories/"), "slug", F.lit(".md")).alias("path"), text.alias("value"))
    md = md.unionByName(spark.createDataFrame([("categories/README.md", "# Read me"), ("categories/documents.md", "none")], "path string, value string"))
    named = F.concat(F.lit('{"slug":"'), "slug", F.lit('","documentSlugs":["'), F.array_join("docs", '","'), F.lit('"]}'))
    return md, rows.where("slug like 'toxic%'").select(named.alias("value"))


def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of Markdown files and of JSON lines, as one list without a slug twice."""
    md, lines = _category_files(spark, sf_dir)
    path = _folder(spark, "categories")
    files.write_lines(lines, path)
    rows = files.merge_by_slug(files.parse_categories(md), files.read_category_jsonl(spark, path))
    return rows.select("slug", "name", F.size("documentSlugs").cast("long").alias("documents"), F.md5(F.array_join("documentSlugs", ",")).alias("slugs_hash"), "content_hash")


def q64b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of category files as they are now, compared with what a manifest kept of them."""
    md, lines = _category_files(spark, sf_dir)
    now = files.category_hashes(md, lines.unionByName(spark.createDataFrame([("{broken",)], "value string")))
    kept = now.where("slug not like '%-0'").withColumn("hash", F.when(F.col("slug").endswith("-1"), F.lit("")).otherwise(F.col("hash")))
    return K.diff(kept, now)


def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in eight files, written and read with the numbers of its lines."""
    path = _folder(spark, "log")
    lines = C.event_lines(spark, sf_dir).withColumn("part", F.pmod("line", F.lit(8)).cast("int"))
    files.write_lines(lines.repartition("part").sortWithinPartitions("part", "line"), path, "part")
    rows = files.numbered_lines(spark, f"{path}/part=*")
    events = E.parse_events(rows.select((F.col("line") * 8 + F.regexp_extract("path", "part=([0-9]+)", 1).cast("int")).alias("line"), "value"))
    return events.select("line", "source_id", "action", "at", "malformed")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.records(spark, sf_dir).select("doc_id", "content", F.concat("guest", F.lit(".md")).alias("file"))
    return I.elements(docs, "doc_id", "content", "file")


def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and chunks as tables; the chunks are made of the elements read back."""
    path = _folder(spark, "elements")
    files.write_elements(_elements(spark, sf_dir), f"{path}/elements")
    rows = files.read_elements(spark, f"{path}/elements")
    I.chunks(rows, "line_start").write.parquet(f"{path}/chunks")
    return spark.read.parquet(f"{path}/chunks").select("doc_id", "chunk_id", T.short_hash(F.col("text")).alias("text_hash"))


def q66b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "elements")
    files.write_elements(_elements(spark, sf_dir), path)
    return files.read_elements(spark, path, 7).select("element_id", "kind", "text")


def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as lines of an author's import, and imported: a section for each document."""
    lines = I.author_jsonl(_elements(spark, sf_dir), "demo").withColumn("v", F.parse_json("value"))
    get = lambda k, t="string": F.variant_get("v", f"$.{k}", t)
    rows = lines.select(get("authorId").alias("author"), get("tocKey").alias("key"), get("metadata.line_start", "int").alias("line"), get("content").alias("text"))
    found = I.group_by_key(rows, "author", "line", "key", "text")
    return found.select(F.col("key").cast("long").alias("doc_id"), F.col("first_line").cast("long").alias("first_line"), F.sha2("body", 256).alias("body_hash"))


def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of Markdown and JSON files as elements: names by content, leaves by path."""
    md = C.table(spark, sf_dir, "documents").select(F.concat(F.lit("in/note "), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("value"))
    js = C.table(spark, sf_dir, "events").select(F.concat(F.lit("in/event_"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("value"))
    rows = files.parse_folder(md, js)
    return rows.groupBy("doc_id").agg(F.count("*").alias("elements"), F.min("element_id").alias("first"), F.max(F.col("line_end").cast("long")).alias("last_line"), F.count_if(F.col("kind") == "json").alias("leaves"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as stored and as they are now: some gone, some new, some with another text."""
    docs = C.records(spark, sf_dir).select("slug", "content", F.md5(F.col("doc_id").cast("string")).alias("m"))
    now = docs.where("m not like 'f%'").withColumn("content", F.when(F.col("m").startswith("1"), F.concat("content", F.lit("\nEdited now."))).otherwise(F.col("content")))
    return docs.where("m not like '0%'").drop("m"), now.drop("m")


def _changes(stored: DataFrame, now: DataFrame) -> DataFrame:
    hashed = lambda df: df.select("slug", T.short_hash(F.col("content")).alias("hash"))
    return K.diff(hashed(stored), hashed(now))


def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written, read, and kept up by what has changed."""
    stored, now = _halves(spark, sf_dir)
    path = _folder(spark, "manifest")
    files.write_manifest(K.totals(stored), path)
    changes = _changes(stored, now)
    gone = stored.join(changes.where("change <> 'added'"), "slug", "left_semi")
    come = now.join(changes.where("change <> 'removed'"), "slug", "left_semi")
    return K.with_changes(files.read_manifest(spark, path), gone, come)


def q69b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents after the changes that a comparison found."""
    stored, now = _halves(spark, sf_dir)
    return K.incremental_update(stored, now, _changes(stored, now)).select("slug", T.short_hash(F.col("content")).alias("hash"))


def q69c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.digest(C.records(spark, sf_dir))


def q69d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash for every document: its own, that of its file, or none."""
    stored, now = _halves(spark, sf_dir)
    own = now.select("slug", F.when(F.col("slug").endswith("7"), F.lit("")).otherwise(T.short_hash(F.col("content"))).alias("content_hash"))
    return K.with_hashes(own, stored.select("slug", T.short_hash(F.col("content")).alias("hash")))


def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored under five keys and read: those of another text, model or dimension don't count."""
    docs = C.records(spark, sf_dir)
    keyed = lambda df, model: df.select("slug", T.short_hash(F.col("content")).alias("content_hash"), F.lit("table").alias("provider"), F.lit(model).alias("model"), F.lit(64).alias("dimension"))
    e = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    met = docs.join(e, "doc_id")
    path = _folder(spark, "vectors")
    half = F.when(F.col("doc_id") % 2 == 0, "m").otherwise("old")
    files.write_vectors(met.select(*[c for c in keyed(docs, "m").columns if c not in ("content_hash", "provider", "model", "dimension")], T.short_hash(F.col("content")).alias("content_hash"), F.lit("table").alias("provider"), half.alias("model"), F.lit(64).alias("dimension"), "vector"), path)
    stored = files.read_vectors(spark, path)
    wanted = keyed(docs, "m")
    found = R.resolve(wanted, stored, lambda missing: missing.withColumn("vector", F.array_repeat(F.lit(0.5).cast("double"), 64)))
    return found.select("slug", "model", F.size("vector").alias("n"), (F.floor(F.col("vector")[0] * 1e6 + 0.5) / 1e6).alias("first"))


def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persona files: tagged, rendered, parsed; one in three has lost its disclaimer's flag."""
    authors = C.records(spark, sf_dir).select("author_id").distinct()
    none = F.lit(None).cast("string")
    people = authors.select("author_id", F.upper("author_id").alias("display_name"), F.lit("Speaks plainly").alias("tagline"), F.array(F.lit("vc")).alias("categories"), none.alias("primary_category"), F.array(F.lit("calm"), F.lit("brief")).alias("voice_traits"), F.array().cast("array<string>").alias("caveats"))
    people = P.tag(people, ["tech", "vc"], list(L.CATEGORIES), "tech")
    chunks = I.chunks(_elements(spark, sf_dir), "line_start")
    docs = C.records(spark, sf_dir).select("doc_id", "author_id")
    claims = P.claims(chunks.join(docs, "doc_id"), "author_id", "doc_id", "line_start")
    text = L.render(people, claims)
    value = F.when(F.col("author_id").endswith("3"), F.replace("text", F.lit("not_real_person: true"), F.lit("not_real_person: no"))).otherwise(F.col("text"))
    back = L.parse(text.select(F.col("author_id").alias("name"), value.alias("value")))
    return back.select("author_id", "display_name", F.array_join("categories", ",").alias("categories"), "primary_category", F.array_join("voice_traits", ",").alias("voice_traits"), "narrative", "problem")


def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register of knowledge sources, appended to and read."""
    path = _folder(spark, "knowledge")
    docs = C.records(spark, sf_dir).select(F.col("slug").alias("doc_id"), F.col("guest").alias("source"), "lang")
    L.knowledge(docs.where("lang = 'en'"), "notes").write.mode("append").parquet(path)
    L.knowledge(docs.where("lang <> 'en'"), "talks", "vc notes", "interview", "2024-05-06").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of a category, each with the category's lens."""
    authors = C.records(spark, sf_dir).select("author_id").distinct()
    people = authors.select("author_id", F.when(F.col("author_id").rlike("[02468]$"), F.array(F.lit("tech"), F.lit("vc"))).otherwise(F.array(F.lit("expert"))).alias("categories"))
    lenses = spark.createDataFrame([(c, f"how a {c} asks") for c in L.CATEGORIES], "category string, lens string")
    return L.panel_lens(P.panel(people, "tech"), lenses, "tech").select("author_id", "category", "lens")


def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each of some guests, by name or dashed name."""
    docs, out = C.records(spark, sf_dir), None
    for name in ("SRC1", "doc 000", "src03:doc", "nobody at all"):
        row = K.by_guest(docs, name).select(F.lit(name).alias("asked"), "slug")
        out = row if out is None else out.unionByName(row)
    return out


def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that may not be tracked, and files with secrets in them."""
    docs = C.table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 10 == 0, "raw/").when(F.col("doc_id") % 10 == 1, "evidence/.gitkeep").when(F.col("doc_id") % 10 == 2, "evidence/").otherwise("docs/")
    name = F.concat(folder, F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".png").otherwise(".md"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, F.lit("\nAuthorization: Bearer abc")).otherwise(""))
    return T.audit_files(docs.select(name.alias("path"), text.alias("value")))


def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a collection: six rules."""
    docs = C.records(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("title"))).withColumn("guest", F.when(F.col("doc_id") % 18 == 0, "").otherwise(F.col("guest")))
    docs = docs.withColumn("content", F.when(F.col("doc_id") % 50 == 3, " ").otherwise(F.col("content")))
    named = C.bridge(spark, sf_dir).withColumn("slug", F.when(F.col("category_slug") == "toxic-1", F.concat("slug", F.lit("-x"))).otherwise(F.col("slug")))
    rows = named.withColumn("part", F.left(F.md5("slug"), F.lit(2))).groupBy(F.concat_ws("-", "category_slug", "part").alias("slug")).agg(F.collect_list("slug").alias("documentSlugs"))
    manifest = docs.agg((F.count("*") + 1).alias("document_count")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("category_count"))))  # one row each
    return K.validate_collection(docs, rows, manifest, docs.where("doc_id % 100 <> 1"))


def q77(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search server's marked text shows of each document."""
    docs = C.records(spark, sf_dir)
    return docs.select("slug", T.marked_snippet(F.regexp_replace("transcript", "(?i)(the)", "<mark>$1</mark>")).alias("snippet"))


def q78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source, and compactions without the place of their backups."""
    docs = C.records(spark, sf_dir).where(T.source_id(F.col("author_id"), F.col("slug")) == "author:src02").select("slug")
    record = E.compaction_record(E.parse_events(C.event_lines(spark, sf_dir))).withColumn("backup_path", F.concat(F.lit("/store/backups/"), "source_id", F.lit(".bak")))
    return docs.select(F.lit("document").alias("kind"), F.col("slug").alias("name")).unionByName(E.public_compactions(record).select(F.lit("backup").alias("kind"), F.col("backup_id").alias("name")))


def q79(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten dimensions of a folder of personas."""
    authors = C.records(spark, sf_dir).select("author_id").distinct()
    none = F.array().cast("array<string>")
    people = authors.select("author_id", F.lit(None).cast("string").alias("display_name"), F.lit("").alias("tagline"), F.array(F.lit("vc")).alias("categories"), F.lit("vc").alias("primary_category"), F.array(F.lit("calm")).alias("voice_traits"), none.alias("caveats"))
    claims = spark.createDataFrame([], "author_id string, claim_id string, text string, quote string, source_file string, line_start int")
    found = L.render(people, claims).select(F.col("author_id").alias("name"), F.concat("text", F.when(F.col("author_id") == "src05", "").otherwise("한글")).alias("value"))
    notes = authors.select(F.col("author_id").alias("name"), F.when(F.col("author_id") == "src04", "notes.md").otherwise("2024-01-02-fit.md").alias("entry"))
    expected = {"categories": list(L.CATEGORIES), "providers": list(P.PROVIDERS), "commands": list(P.COMMANDS), "dimensions": list(P.DIMENSIONS)}
    return P.persona_benchmark(L.score(found, notes), expected)


def q80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has changed in documents and categories together, and what that means for the index."""
    stored, now = _halves(spark, sf_dir)
    hashed = lambda df: df.select("slug", T.short_hash(F.col("content")).alias("hash"))
    sizes = C.bridge(spark, sf_dir).groupBy("category_slug").agg(F.count("*").cast("string").alias("hash")).withColumnRenamed("category_slug", "slug")
    changed = K.collection_diff((hashed(stored), sizes.where("slug <> 'toxic-1'")), (hashed(now), sizes.where("slug <> 'toxic-0'")))
    plan = K.update_plan(changed.where("kind = 'document'"), changed.where("kind = 'category'"))
    return changed.unionByName(plan.select(F.lit("plan").alias("kind"), F.lit("").alias("slug"), F.col("mode").alias("change"), F.lit(None).cast("string").alias("previous_hash"), F.lit(None).cast("string").alias("next_hash")))


def q81(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON with its keys in order at every depth."""
    rows = C.table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.lit(1).alias("z"), F.array(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))).alias("a")).alias("y"), F.col("o_orderpriority").alias("b"), F.lit(None).cast("string").alias("n"))
    return rows.select("o_orderkey", J.stable_text(rows, "y", "b", "n").alias("text"))


def q92(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clones by name, with the chats that were kept with each."""
    clones = q71(spark, sf_dir).select(F.col("author_id").alias("name"), "problem")
    turns = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("src"), F.lpad((F.col("conv_id") % 7).cast("string"), 2, "0")).alias("author_id"))
    return L.listed(clones, turns)


def q93(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after imports, a dry run, changes, a deletion and a compaction: its documents and its log."""
    memory = DocumentMemory(spark, _folder(spark, "memory"))
    text = F.col("content")
    rows = C.records(spark, sf_dir).select(
        "doc_id", "slug", F.col("slug").alias("document_slug"), "author_id", "source", "title", "guest", "keywords", "publish_date", F.lit("").alias("original_url"), "content", "transcript",
        T.word_count(text).alias("word_count"), T.short_hash(text).alias("content_hash"),
    )
    changed = rows.withColumn("content_hash", F.when(F.col("doc_id") % 2 == 0, T.short_hash(F.concat(F.lit("new "), text))).otherwise(F.col("content_hash")))
    for author, docs, dry in (("src03", rows, False), ("src05", rows, False), ("src05", changed, True), ("src03", changed, False)):
        memory.import_documents(author, docs, dry)
    memory.delete("author:src05")
    memory.compact("author:src03", keep=1)
    documents = memory.documents().select(F.lit("document").alias("kind"), F.col("slug").alias("name"), F.col("content_hash").alias("value"))
    events = E.valid(memory.events()).select(F.lit("event").alias("kind"), F.concat_ws(" ", "source_id", "action").alias("name"), F.col("document_count").cast("long").cast("string").alias("value"))
    return documents.unionByName(events)


QUERIES = {
    "q60_posts_table": q60, "q61_post_files": q61, "q62_transcript_files": q62, "q63_document_jsonl": q63, "q64_category_files": q64, "q64_category_hashes": q64b, "q65_event_log_files": q65,
    "q66_elements_and_chunks": q66, "q66_elements_of_one": q66b, "q67_author_jsonl": q67, "q68_folder_ingest": q68, "q69_manifest_upkeep": q69, "q69_incremental_update": q69b, "q69_collection_digest": q69c,
    "q69_hash_fallback": q69d, "q70_stored_vectors": q70, "q71_persona_files": q71, "q72_knowledge_register": q72, "q73_panel_lens": q73, "q74_guest_lookup": q74, "q75_file_audit": q75,
    "q76_collection_rules": q76, "q77_marked_snippet": q77, "q78_public_views": q78, "q79_persona_benchmark": q79, "q92_clones_listed": q92, "q93_store_lifecycle": q93, "q80_changes_of_both": q80, "q81_stable_json": q81,
}

_WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))::BIGINT"
_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '^---[\\s\\S]*?---\\s*', ''), '(?m)^#{{1,6}}\\s+', '', 'g'), '\\s+', ' ', 'g'))"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"
POSTS = f"""{REC}, po AS (SELECT author_id, title || ' ' || doc_id AS title, content, 'author:' || author_id || ':' || {_SLUG.format("(title || ' ' || doc_id)")} AS slug, {_SLUG.format("(title || ' ' || doc_id)")} AS document_slug,
  left(sha256(author_id || chr(10) || title || ' ' || doc_id || chr(10) || content), 16) AS content_hash FROM rec)"""
CATS = f"""{REC}, {BRIDGE}, cp AS (SELECT category_slug || '-' || left(md5(slug), 1) AS cat, slug FROM bridge),
cr AS (SELECT cat, count(*) AS n, string_agg(slug, ',' ORDER BY slug) AS list, string_agg('- [t](../documents/' || slug || '/transcript.md)', chr(10) ORDER BY slug) AS links, string_agg(slug, '","' ORDER BY slug) AS quoted FROM cp GROUP BY cat),
ct AS (SELECT cat, n, list, CASE WHEN cat LIKE 'toxic%' THEN '{{"slug":"' || cat || '","documentSlugs":["' || quoted || '"]}}' ELSE '# Name of ' || cat || chr(10) || chr(10) || links || chr(10) END AS raw FROM cr)"""
LINES = f"""{REC},
ln AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS n FROM documents),
el AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, doc_id || ':e' || row_number() OVER (PARTITION BY doc_id ORDER BY n) AS element_id FROM ln WHERE regexp_replace(line, '\\s+', '', 'g') <> '')"""
HALVES = f"""{REC}, h AS (SELECT slug, content, md5(doc_id::VARCHAR) AS m FROM rec), st AS (SELECT slug, content FROM h WHERE NOT starts_with(m, '0')),
nw AS (SELECT slug, CASE WHEN starts_with(m, '1') THEN content || chr(10) || 'Edited now.' ELSE content END AS content FROM h WHERE NOT starts_with(m, 'f'))"""
_KINDS = "[" + ", ".join(f"CASE WHEN regexp_matches(value, '{p}') THEN '{k}' END" for k, p in T.SECRET_FORMS.items()) + "]"
SQL = {
    "q60_posts_table": f"""WITH {POSTS}, e AS (SELECT *, CASE WHEN author_id = '{EDITED}' THEN content || chr(10) || 'Edited.' ELSE content END AS c FROM po)
SELECT slug, author_id AS guest, title, 'import.md' AS original_url, left(sha256(c), 16) AS file_hash, content_hash, {_WORDS.format(_STRIP.format('content'))} AS word_count FROM e""",
    "q61_post_files": f"WITH {POSTS} SELECT author_id, document_slug, slug, title, 'import.md' AS source_url, NULL::VARCHAR AS published_at, content_hash, sha256({_TRIM.format('content')}) AS body_hash FROM po",
    "q62_transcript_files": f"""WITH {REC}, t AS (SELECT *, 'x ' || content || ' y' AS t FROM rec)
SELECT slug, nullif(guest, '') AS guest, publish_date, doc_id AS views, NULL::VARCHAR AS duration, coalesce(lang, 'none') || ',two words' AS keywords, sha256(t) AS transcript_hash, {_WORDS.format('t')} AS word_count FROM t""",
    "q63_document_jsonl": f"""WITH {REC}, t AS (SELECT slug, md5(content) AS title, 'a ' || md5(content) || ' b' AS content, CASE WHEN doc_id % 2 = 0 THEN 'content' ELSE 'transcript' END AS k FROM rec)
SELECT slug, title, content, content AS transcript, 3::BIGINT AS word_count, left(sha256('{{"slug":"' || slug || '","metadata":{{"title":"' || title || '"}},"' || k || '":"' || content || '"}}'), 16) AS content_hash FROM t""",
    "q64_category_files": f"WITH {CATS} SELECT cat AS slug, CASE WHEN cat LIKE 'toxic%' THEN cat ELSE 'Name of ' || cat END AS name, n AS documents, md5(list) AS slugs_hash, left(sha256(raw), 16) AS content_hash FROM ct",
    "q64_category_hashes": f"""WITH {CATS}, nw AS (SELECT cat AS slug, left(sha256(raw), 16) AS h FROM ct UNION ALL SELECT 'README', left(sha256('# Read me'), 16) UNION ALL SELECT 'documents', left(sha256('none'), 16))
SELECT slug, 'added' AS change, NULL::VARCHAR AS previous_hash, h AS next_hash FROM nw WHERE slug LIKE '%-0' OR slug LIKE '%-1'""",
    "q65_event_log_files": f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY line % 8 ORDER BY line) * 8 + line % 8 AS at_line, action IN ('import', 'refresh', 'delete') AND source_id IS NOT NULL AND at_ IS NOT NULL AS ok FROM ev)
SELECT at_line AS line, source_id, action, at_ AS at, NOT coalesce(ok, false) AS malformed FROM n""",
    "q66_elements_and_chunks": f"WITH {LINES} SELECT doc_id, element_id || ':c' || row_number() OVER (ORDER BY doc_id, n) AS chunk_id, left(sha256(line), 16) AS text_hash FROM el",
    "q66_elements_of_one": f"WITH {LINES} SELECT element_id, CASE WHEN starts_with(trim(line), '#') THEN 'heading' WHEN regexp_matches(trim(line), '^[-*]\\s+') THEN 'list' WHEN contains(line, '|') THEN 'table' ELSE 'paragraph' END AS kind, line AS text FROM el WHERE doc_id = 7",
    "q67_author_jsonl": f"WITH {LINES} SELECT doc_id, min(n)::BIGINT AS first_line, sha256({_TRIM.format("'# ' || doc_id || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n)")}) AS body_hash FROM el GROUP BY doc_id",
    "q68_folder_ingest": f"""WITH {LINES}, d AS (SELECT doc_id, 'note-' || doc_id || '-md-' || left(sha1('note ' || doc_id || '.md' || chr(10) || coalesce(text, '')), 12) AS id FROM documents),
j AS (SELECT event_id, 'event_' || event_id || '-json-' || left(sha1('event_' || event_id || '.json' || chr(10) || props), 12) AS id, len(json_keys(props)) AS k FROM events)
SELECT d.id AS doc_id, count(*) AS elements, min(d.id || ':e' || k) AS first, max(n)::BIGINT AS last_line, 0::BIGINT AS leaves FROM el JOIN d USING (doc_id) GROUP BY d.id UNION ALL
SELECT id, k, id || ':e1', 1, k FROM j WHERE k > 0""",
    "q69_manifest_upkeep": f"WITH {HALVES} SELECT count(*) AS document_count, sum(strlen(content))::BIGINT AS content_bytes, sum({_WORDS.format('content')})::BIGINT AS content_words FROM nw",
    "q69_incremental_update": f"WITH {HALVES} SELECT slug, left(sha256(content), 16) AS hash FROM nw",
    "q69_collection_digest": f"""WITH {REC}, b AS (SELECT left(md5(slug), 3) AS bucket, count(*) AS n, sha256(string_agg(slug || ' ' || left(sha256(content), 16), chr(10) ORDER BY slug)) AS h FROM rec GROUP BY 1)
SELECT left(sha256(string_agg(bucket || ' ' || n || ' ' || h, chr(10) ORDER BY bucket)), 16) AS digest FROM b""",
    "q69_hash_fallback": f"WITH {HALVES} SELECT nw.slug, CASE WHEN nw.slug LIKE '%7' THEN coalesce(left(sha256(st.content), 16), '') ELSE left(sha256(nw.content), 16) END AS content_hash FROM nw LEFT JOIN st USING (slug)",
    "q70_stored_vectors": f"WITH {REC} SELECT slug, 'm' AS model, 64 AS n, CASE WHEN vec_id IS NOT NULL AND doc_id % 2 = 0 THEN floor(embedding[1]::DOUBLE * 1e6 + 0.5) / 1e6 ELSE 0.5 END AS first FROM rec LEFT JOIN embeddings ON vec_id = doc_id",
    "q71_persona_files": f"""WITH {LINES}, a AS (SELECT DISTINCT author_id FROM rec), c AS (SELECT author_id, arg_min(line, (doc_id, n)) AS line FROM el JOIN rec USING (doc_id) GROUP BY author_id)
SELECT author_id, upper(author_id) AS display_name, 'vc,tech' AS categories, 'tech' AS primary_category, 'calm,brief' AS voice_traits,
  CASE WHEN line IS NULL THEN '{L.NO_CLAIM}' ELSE {_TRIM.format(f"'{P.GROUNDED}' || left(line, {P.QUOTE})")} END AS narrative, CASE WHEN author_id LIKE '%3' THEN 'not_real_person is not declared' END AS problem FROM a LEFT JOIN c USING (author_id)""",
    "q72_knowledge_register": f"""WITH {REC} SELECT slug AS doc_id, guest AS source, CASE WHEN lang = 'en' THEN 'notes' ELSE 'talks' END AS source_label, CASE WHEN lang <> 'en' THEN 'vc notes' END AS category, CASE WHEN lang <> 'en' THEN 'interview' END AS source_type,
  CASE WHEN lang <> 'en' THEN '2024-05-06' END AS published_at, CASE WHEN lang <> 'en' THEN '2024-05-06-vc-notes.md' END AS stub FROM rec WHERE lang IS NOT NULL""",
    "q73_panel_lens": f"WITH {REC} SELECT author_id, 'tech' AS category, 'how a tech asks' AS lens FROM (SELECT DISTINCT author_id FROM rec WHERE regexp_matches(author_id, '[02468]$') ORDER BY author_id LIMIT 5)",
    "q74_guest_lookup": f"WITH {REC}, q AS (SELECT unnest(['SRC1', 'doc 000', 'src03:doc', 'nobody at all']) AS asked) SELECT asked, min(slug) AS slug FROM q JOIN rec ON contains(lower(guest), lower(asked)) OR contains(slug, replace(lower(asked), ' ', '-')) GROUP BY asked",
    "q75_file_audit": f"""WITH f AS (SELECT CASE doc_id % 10 WHEN 0 THEN 'raw/' WHEN 1 THEN 'evidence/.gitkeep' WHEN 2 THEN 'evidence/' ELSE 'docs/' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.png' ELSE '.md' END AS path,
  coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Authorization: Bearer abc' ELSE '' END AS value, doc_id FROM documents)
SELECT path, 'forbidden path' AS problem FROM f WHERE doc_id % 10 IN (0, 2) UNION ALL SELECT path, p FROM (SELECT path, unnest({_KINDS}) AS p FROM f WHERE path NOT LIKE '%.png') WHERE p IS NOT NULL""",
    "q76_collection_rules": f"""WITH {REC}, {BRIDGE}, d AS (SELECT doc_id, slug, CASE WHEN doc_id % 9 = 0 THEN '' ELSE title END AS title, CASE WHEN doc_id % 18 = 0 THEN '' ELSE guest END AS guest, CASE WHEN doc_id % 50 = 3 THEN ' ' ELSE content END AS content FROM rec),
e AS (SELECT category_slug, CASE WHEN category_slug = 'toxic-1' THEN slug || '-x' ELSE slug END AS slug FROM bridge)
SELECT 'error' AS level, 'missing-title-and-guest' AS rule, slug AS name FROM d WHERE trim(title) = '' AND trim(guest) = '' UNION ALL SELECT 'warning', 'empty-content', slug FROM d WHERE trim(content) = '' UNION ALL
SELECT 'error', 'unknown-document', category_slug || '-' || left(md5(slug), 2) || ' ' || slug FROM e WHERE slug NOT IN (SELECT slug FROM rec) UNION ALL SELECT 'error', 'manifest-count', 'documents' UNION ALL SELECT 'error', 'not-indexed', slug FROM rec WHERE doc_id % 100 = 1""",
    "q77_marked_snippet": f"""WITH {REC}, m AS (SELECT slug, regexp_replace(transcript, '(the)', '<mark>\\1</mark>', 'gi') AS t FROM rec), a AS (SELECT *, strpos(t, '<mark>') - 1 AS at_ FROM m)
SELECT slug, trim(CASE WHEN at_ < 0 THEN left(t, 160) ELSE substr(t, greatest(0, at_ - 80) + 1, least(length(t), at_ + 136) - greatest(0, at_ - 80)) END) AS snippet FROM a""",
    "q78_public_views": f"WITH {REC}, {EVENTS} SELECT 'document' AS kind, slug AS name FROM rec WHERE author_id = 'src02' UNION ALL SELECT DISTINCT 'backup', source_id || '.bak' FROM good",
    "q80_changes_of_both": f"""WITH {HALVES}, {BRIDGE}, x AS (SELECT slug, left(sha256(content), 16) AS h FROM st), y AS (SELECT slug, left(sha256(content), 16) AS h FROM nw)
SELECT 'document' AS kind, coalesce(x.slug, y.slug) AS slug, CASE WHEN x.slug IS NULL THEN 'added' WHEN y.slug IS NULL THEN 'removed' ELSE 'changed' END AS change, x.h AS previous_hash, y.h AS next_hash FROM x FULL JOIN y ON x.slug = y.slug WHERE x.h IS DISTINCT FROM y.h UNION ALL
SELECT 'category', category_slug, CASE WHEN category_slug = 'toxic-1' THEN 'added' ELSE 'removed' END, CASE WHEN category_slug = 'toxic-0' THEN count(*)::VARCHAR END, CASE WHEN category_slug = 'toxic-1' THEN count(*)::VARCHAR END FROM bridge WHERE category_slug IN ('toxic-0', 'toxic-1') GROUP BY category_slug UNION ALL
SELECT 'plan', '', 'full', NULL, NULL""",
    "q81_stable_json": """SELECT o_orderkey, '{"b":"' || o_orderpriority || '","y":{"a":[{"c":' || o_custkey || ',"s":"' || o_orderstatus || '"}],"z":1}}' AS text FROM orders""",
    "q79_persona_benchmark": f"""WITH {REC}, a AS (SELECT count(*) FILTER (author_id = 'src05') = 0 AS q, count(*) FILTER (author_id = 'src04') = 0 AS k FROM rec), r AS (SELECT unnest([
  {{'dimension': 'personaSchema', 'pass': true}}, {{'dimension': 'personaQuality', 'pass': q}}, {{'dimension': 'personaChatReadiness', 'pass': true}}, {{'dimension': 'categoryPanelReadiness', 'pass': true}},
  {{'dimension': 'groupRoomReadiness', 'pass': true}}, {{'dimension': 'standaloneCliReadiness', 'pass': true}}, {{'dimension': 'providerParity', 'pass': true}}, {{'dimension': 'migrationReadiness', 'pass': k}},
  {{'dimension': 'securityReadiness', 'pass': q AND k}}, {{'dimension': 'overall', 'pass': q AND k}}]) AS r FROM a) SELECT r.dimension AS dimension, r.pass AS pass, CASE WHEN r.pass THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM r""",
}
SQL["q92_clones_listed"] = f"""WITH c AS ({SQL['q71_persona_files']}), t AS (SELECT 'src' || lpad((conv_id % 7)::VARCHAR, 2, '0') AS name, count(DISTINCT conv_id) AS sessions, count(*) AS turns FROM conversations GROUP BY 1)
SELECT author_id AS name, problem, coalesce(sessions, 0) AS sessions, coalesce(turns, 0) AS turns FROM c LEFT JOIN t ON author_id = name"""
SQL["q93_store_lifecycle"] = f"""WITH {REC}, n AS (SELECT author_id, count(*) AS n FROM rec GROUP BY 1)
SELECT 'document' AS kind, slug AS name, left(sha256((CASE WHEN doc_id % 2 = 0 THEN 'new ' ELSE '' END) || content), 16) AS value FROM rec WHERE author_id = 'src03'
UNION ALL SELECT 'event', 'author:src03 import', n::VARCHAR FROM n WHERE author_id = 'src03'
UNION ALL SELECT 'event', 'author:src05 ' || unnest(['import', 'delete']), n::VARCHAR FROM n WHERE author_id = 'src05'"""
