"""The document memory as one object: what a user of the store can ask and change.

Tables live under one folder that Spark can reach. A change writes new files for the parts of a table that it
changes (documents are kept in ``PARTS`` parts by author) and then a row that names them, so readers see the old version
or the new one, and a job that dies in between changes nothing. The event log is only ever appended to, a file of one
line an event, but for compactions. Writers hold a lock file.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions import text as T
from .operators import catalog as K
from .operators import export as E
from .operators import ingest as I
from .operators import lifecycle as L
from .operators import search as S
from .operators.engine import IndexEngine
from .sources import files, paths

DOCUMENTS = "slug string, document_slug string, author_id string, source string, title string, guest string, keywords array<string>, publish_date string, original_url string, content string, transcript string, word_count bigint, content_hash string"
LOG = "line bigint, value string"
BRIDGE = "slug string, category_slug string"
COMPACTIONS = "source_id string, retained bigint, removed bigint, skipped_malformed bigint, compacted_at string, backup_path string"
TABLES = {"documents": DOCUMENTS, "log": LOG, "bridge": BRIDGE, "compactions": COMPACTIONS}
VERSIONS = "name string, part int, version long, path string"
SECTIONS = ("metadata", "summary", "full")
PARTS = 64
LINES = 256  # events after which the files of the log are merged


class NotFound(LookupError):
    """What was asked for isn't there."""


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class DocumentMemory:
    def __init__(self, spark: SparkSession, root: str, authors: str | None = None, imports: str | None = None, layout: str = files.POSTS) -> None:
        self.spark, self.root, self.authors, self.imports, self.layout = spark, root.rstrip("/"), authors, imports, layout
        #: from a query to a function that reranks its results, see ``search.search``; none: by keywords
        self.reranker = None
        #: how the provider of vectors has fared
        self.diagnostics = None

    # tables
    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def _paths(self, name: str) -> dict[int, tuple[int, str]]:
        """The last version and path of each part of a table, at most ``PARTS``."""
        rows = self._versions().where(F.col("name") == name).groupBy("part").agg(F.max(F.struct("version", "path")).alias("last"))
        return {r["part"]: tuple(r["last"]) for r in rows.collect()}

    def table(self, name: str, part: int | None = None) -> DataFrame:
        found = [p for k, (_, p) in sorted(self._paths(name).items()) if part in (None, k)]
        return self.spark.read.schema(TABLES[name]).parquet(*found) if found else self.spark.createDataFrame([], TABLES[name])

    def _put(self, name: str, rows: DataFrame, part: int = 0) -> str:
        version = self._paths(name).get(part, (0, ""))[0] + 1
        path = f"{self.root}/{name}-{part:02d}-{version:06d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        self.spark.createDataFrame([(name, part, version, path)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return path

    def _lock(self):
        return storage.locked(self.spark, f"{self.root}/lock")

    def _record(self, source: str, action: str, documents: int) -> None:
        """One line, as a file, numbered after the last that was given out: under the lock, so that the order of lines is that of events whatever
        clocks say. Files of single lines are written together when there are ``LINES`` of them."""
        line = storage.next_number(self.spark, f"{self.root}/lines")
        new = self.spark.createDataFrame([(line, files.event_line(source, action, now(), documents))], LOG).coalesce(1)
        log = self._paths("log").get(0)
        if log is None:
            self._put("log", new)
        else:
            new.write.mode("append").parquet(log[1])
            if line % LINES == 0:
                rows = self.table("log")
                self._put("log", rows.repartitionByRange("line").sortWithinPartitions("line"))

    def documents(self) -> DataFrame:
        return self.table("documents")

    def events(self) -> DataFrame:
        return L.parse_events(self.table("log"))

    def _key(self) -> str:
        """What the documents are now: the last version of each part."""
        return ",".join(f"{k}:{v}" for k, (v, _) in sorted(self._paths("documents").items()))

    # the index
    def reindex(self) -> None:
        """An index of all documents, which searches read and imports and deletions keep up from then on."""
        IndexEngine.build(self.documents(), f"{self.root}/index", self._key())

    def _engine(self):
        return IndexEngine.open(self.spark, f"{self.root}/index", self._key())

    def source_of_searches(self):
        """The index if there is one of the documents as they are, else the documents."""
        return self._engine() or self.documents()

    # imports
    def _apply(self, incoming: DataFrame, dry_run: bool) -> DataFrame:
        """Puts in what came in; returns the table of what changed, which stays. The rows that came in are written first, so
        that their order is one and the same wherever they are read."""
        at = f"{self.root}/changes-{uuid.uuid4().hex[:8]}"
        incoming.withColumn("ord", F.monotonically_increasing_id()).write.parquet(f"{at}/incoming")
        rows = self.spark.read.parquet(f"{at}/incoming")
        hashed = lambda df, *more: df.select("slug", F.col("content_hash").alias("hash"), *more)
        part = F.pmod(F.xxhash64("author_id"), F.lit(PARTS)).cast("int")
        touched = sorted(r[0] for r in rows.select(part).distinct().collect())
        stored = {k: self.table("documents", k) for k in touched}
        kept = self.spark.createDataFrame([], DOCUMENTS)
        for one in stored.values():
            kept = kept.unionByName(one)
        K.changeset(hashed(kept), hashed(rows, "title", "ord")).write.parquet(f"{at}/changes")
        changes = self.spark.read.parquet(f"{at}/changes")
        if not dry_run:
            engine = self._engine()
            for k, one in stored.items():
                self._put("documents", K.upsert(one, rows.where(part == k)), k)
            if engine is not None:
                last = K.upsert(self.spark.createDataFrame([], DOCUMENTS), rows)
                engine.add(last.join(changes.where("action <> 'skipped'").select("slug").distinct(), "slug", "left_semi"), self._key())
        return changes

    def import_author(self, author: str, text: str, name: str = "inline.md", toc_key: str | None = None, dry_run: bool = False, split_by: str | None = None) -> DataFrame:
        """Sections of a text as documents; returns what was added, updated or skipped."""
        posts = files.import_author(self.spark, author, text, name, toc_key, split_by)
        with self._lock():
            changes = self._apply(I.documents_of(posts), dry_run)
            if not dry_run:
                self._record(f"author:{author}", "import", changes.count())
        return changes

    def import_documents(self, author: str, documents: DataFrame, dry_run: bool = False) -> DataFrame:
        """``import_author`` of documents that are there as rows, of any number; rows of other authors are left out."""
        rows = documents.where(F.col("author_id") == author).select(*(x.split()[0] for x in DOCUMENTS.split(", ")))
        with self._lock():
            changes = self._apply(rows, dry_run)
            if not dry_run:
                self._record(f"author:{author}", "import", changes.count())
        return changes

    def import_file(self, author: str, root: str, name: str, **options) -> DataFrame:
        """``import_author`` of a file under ``root``, of a kind and size that may be imported."""
        path = paths.import_file(root, name)
        return self.import_author(author, path.read_text("utf-8"), path.name, **options)

    def refresh(self, source: str, dry_run: bool = False) -> dict:
        """Reads an author's stored posts again; of the others' nothing is read."""
        paths.source_id(source)
        author = source.split(":", 1)[1]
        if self.authors is None:
            raise ValueError("no folder of authors")
        if self._of(source).isEmpty() and L.valid(self.events()).where(F.col("source_id") == source).isEmpty():
            raise NotFound(source)
        failed = {"source_id": source, "status": "failed", "added": 0, "updated": 0, "skipped": 0}
        try:
            raw = files.whole(self.spark, f"{self.authors}/{self.layout.format(author=author, slug='*')}")
            posts = files.parse_posts(raw)
            n, parsed = raw.count(), posts.count()
        except Exception:  # whatever keeps a store from being read
            return failed | {"reason": "unreadable"}
        if n == 0 or parsed != n:
            return failed | {"reason": "missing-storage" if n == 0 else "parse-error"}
        posts = posts.where(F.col("author_id") == author)
        with self._lock():
            changes = self._apply(I.documents_of(posts), dry_run)
            counts = K.counters(changes).first().asDict()
            if not dry_run:
                self._record(source, "refresh", sum(counts.values()))
        return {"source_id": source, "status": "changed" if counts["added"] + counts["updated"] else "unchanged", "reason": None, **counts}

    # questions
    def search(self, query: str, reranker=None, **options) -> DataFrame:
        return S.search(self.source_of_searches(), S.Search(query, **options), self.table("bridge"), reranker)

    def explain(self, query: str, **options) -> DataFrame:
        return S.explain(self.source_of_searches(), S.Search(query, **options), self.table("bridge"))

    def compare(self, query: str, **options) -> DataFrame:
        return S.compare(self.source_of_searches(), S.Search(query, **options), self.table("bridge"))

    def document(self, slug: str | None = None, section: str = "full", guest: str | None = None) -> str:
        """A section of a document, named by its slug or found by its guest."""
        if section not in SECTIONS:
            raise ValueError(f"no such section: {section}")
        if slug is None:
            found = K.by_guest(self.documents(), guest).first() if guest else None
            if found is None:
                raise NotFound(guest or "unknown")
            slug = found["slug"]
        content = F.col("content")
        view = {"metadata": T.metadata_section(content), "summary": T.first_lines(content, 200), "full": content}[section]
        row = self.documents().where(F.col("slug") == slug).select(view.alias("text")).first()
        if row is None:
            raise NotFound(slug)
        return row["text"]

    def sources(self) -> DataFrame:
        return L.sources(self.documents(), self.events())

    def _of(self, source: str) -> DataFrame:
        paths.source_id(source)
        return self.documents().where(T.source_id(F.col("author_id"), F.col("slug")) == source)

    def source(self, source: str) -> DataFrame:
        rows = self._of(source).select("slug", "title").orderBy("slug")
        if rows.isEmpty():
            raise NotFound(source)
        return rows

    def status(self, source: str) -> DataFrame:
        paths.source_id(source)
        return L.status(self.events(), self.table("compactions")).where(F.col("source_id") == source)

    def history(self, source: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
        return L.history(self.events(), source, offset, limit)

    def export(self, source: str, history: bool = False) -> tuple[DataFrame, DataFrame]:
        """Documents with their provenance, and the manifest with its checksums."""
        self.source(source)
        rows = E.export_documents(self._of(source))
        events = L.valid(self.events()).where(F.col("source_id") == source) if history else None
        return rows, E.export_manifest(rows, events)

    def stats(self) -> dict:
        return K.manifest(self.documents()).first().asDict() | {"sources": self.sources().count(), "categories": self.table("bridge").select("category_slug").distinct().count()}

    def ready(self) -> dict:
        """Ready with documents, and an index of them if there ever was one."""
        loaded = not self.documents().isEmpty()
        indexed = loaded and (self._engine() is not None or not storage.exists(self.spark, f"{self.root}/index/state"))
        return {"documents": loaded, "index": indexed, "ready": loaded and indexed}

    def validate(self) -> DataFrame:
        return K.validate(self.documents(), self.table("bridge"))

    # changes
    def delete(self, source: str) -> int:
        """Takes a source's documents out; its history stays."""
        with self._lock():
            gone = self._of(source).select("slug", "author_id")
            n = gone.count()
            if n == 0:
                raise NotFound(source)
            engine = self._engine()
            part = F.pmod(F.xxhash64("author_id"), F.lit(PARTS)).cast("int")
            at = f"{self.root}/changes-{uuid.uuid4().hex[:8]}"
            gone.withColumn("part", part).write.parquet(at)
            gone = self.spark.read.parquet(at)
            for k in sorted(r[0] for r in gone.select("part").distinct().collect()):
                self._put("documents", K.remove(self.table("documents", k), gone), k)
            self._put("bridge", K.remove(self.table("bridge"), gone))
            if engine is not None:
                engine.remove(gone, self._key())
            self._record(source, "delete", n)
        return n

    def compact(self, source: str, keep: int = L.KEEP) -> dict:
        """Leaves a source its last events and drops malformed lines; the log as it was stays as the backup."""
        paths.source_id(source)
        with self._lock():
            backup = self._paths("log").get(0)
            if backup is None:
                raise NotFound(source)
            if problems := L.bad_compactions(self.table("compactions")).limit(1).collect():
                raise ValueError(f"a record of an earlier compaction is broken, the log stays as it is: {problems[0]['problem']}")
            events = self.events()
            record = L.compaction_record(events, keep).where(F.col("source_id") == source).first()
            if record is None:
                raise NotFound(source)
            kept = L.compact(events, keep, source).select("line")
            self._put("log", self.table("log").join(kept, "line", "left_semi"))
            row = (source, record["retained"], record["removed"], record["skipped_malformed"], now(), backup[1])
            self._put("compactions", self.table("compactions").unionByName(self.spark.createDataFrame([row], COMPACTIONS)))
        return dict(zip(("source_id", "retained", "removed", "skipped_malformed", "compacted_at"), row, strict=False)) | {"backup_id": backup[1].rsplit("/", 1)[-1]}

    def set_categories(self, categories: DataFrame) -> None:
        """The category index from ``categories(slug, documentSlugs)`` and the documents' keywords."""
        own = K.category_bridge(self.documents(), categories)
        self._put("bridge", K.enrich(self.documents(), categories.select(F.col("slug").alias("category_slug")), own))


def as_markdown(title: str, rows: DataFrame, most: int = 50) -> str:
    """A page of rows as text: a heading for each, and its columns as a list."""
    lines = [f"# {title}", ""]
    for i, r in enumerate(rows.limit(most).collect(), 1):
        fields = r.asDict()
        head = fields.pop("title", None) or fields.get("slug") or fields.get("source_id") or str(i)
        lines += [f"## {i}. {head}", *(f"- {k.replace('_', ' ')}: {v}" for k, v in fields.items() if v is not None), ""]
    return "\n".join(lines if len(lines) > 2 else [*lines, "Nothing found.", ""])
