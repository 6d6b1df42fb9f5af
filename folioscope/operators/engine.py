"""Search engines over a collection: one that scans the documents, one that reads an index kept as tables.

An engine has ``matches``, all results of a search without their texts' being read for more than has to
be, and ``whole``, the rows of one page with all columns of their documents.

The index is two tables for each of its segments. Postings lie in a folder for each shard, a shard being a hash of
a token's first two letters. A folder's files hold the postings of some megabytes of texts each, sorted by token, so that a prefix is a range of
each file of one folder; they are made where their documents are, and no posting is shuffled. Documents lie in
folders by a hash of their slug, some thousands in each, and are sorted by slug: the documents of given slugs are read from their
folders alone. No other folder is listed, opened or read.

A search takes two steps: one scan of the postings of its prefixes gives the hits, at most ``FIELD_CAP`` a field, which come to the driver;
their documents are then read by slug.

Added documents are a segment more; a document counts in the last segment that names it, and removed slugs are a
segment that names them and has no documents. What a search joins for that is the slugs of later segments
alone. ``merge`` makes one segment of all.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import storage
from ..functions.query import parse_query
from . import search as S
from .local import local_rows, one_of

FORMAT = 4  # of the tables; an index of another is not read
MOST_SEGMENTS = 16  # more are merged
POSTINGS = "token string, slug string, first_pos int, field string, shard int"
SHARDS = 16  # folders of postings, at most, each with a file of every task; SHARDS_A_PART for each folder of documents
SHARDS_A_PART = 8
LETTERS_A_TASK = 16_000_000  # of texts whose postings one task makes and sorts
HEAD = 2  # letters of a token that name its shard
DOCUMENTS_A_PART = 20_000


class ScanEngine:
    """Reads the documents for every search."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs

    def matches(self, wanted: S.Search, categories: DataFrame | None = None) -> DataFrame:
        return S.matches(self.docs, wanted, categories)

    def whole(self, rows: DataFrame) -> DataFrame:
        return rows


class IndexEngine:
    """Reads the postings of a query's prefixes, the documents of its hits, and texts of a hit for phrases and of the page."""

    def __init__(self, spark: SparkSession, root: str, state: dict) -> None:
        self.spark, self.root, self.state = spark, root, state

    # upkeep
    @classmethod
    def build(cls, docs: DataFrame, root: str, key: str) -> IndexEngine:
        """An index of ``docs``, named ``key`` after what it was made from. The state is written last."""
        spark = docs.sparkSession
        engine = cls(spark, root.rstrip("/"), {"format": FORMAT, "key": key, "schema": docs.schema.json(), "segments": []})
        return engine._with(engine._segment(docs), key)

    @classmethod
    def open(cls, spark: SparkSession, root: str, key: str | None = None) -> IndexEngine | None:
        """The index under ``root``; none if there is none, or one of another format or key."""
        root = root.rstrip("/")
        last = storage.last_version(spark, f"{root}/state")
        if not last:
            return None
        state = json.loads(storage.read_text(spark, f"{root}/state/{last:08d}"))
        return cls(spark, root, state) if state["format"] == FORMAT and key in (None, state["key"]) else None

    def _segment(self, docs: DataFrame, name: str | None = None) -> str:
        """Writes a segment; one that has a name may have been begun before, and is written anew."""
        name = name or uuid.uuid4().hex[:12]
        folder = f"{self.root}/{name}"
        storage.remove(self.spark, folder)
        parts = max(1, docs.count() // DOCUMENTS_A_PART)
        dealt = docs.withColumn("part", F.pmod(F.xxhash64("slug"), F.lit(parts)).cast("int"))
        dealt.repartition(parts, "part").sortWithinPartitions("part", "slug").write.partitionBy("part").parquet(f"{folder}/documents")
        kept = self.spark.read.schema(dealt.schema).parquet(f"{folder}/documents")
        letters = kept.agg(F.sum(sum(F.length(t) for t in S.field_texts().values()))).first()[0] or 0
        rows = S.postings(kept.repartition(1 + letters // LETTERS_A_TASK, "slug")).select("token", "slug", F.col("first_pos").cast("int").alias("first_pos"), "field", F.pmod(head_of(F.col("token")), F.lit(_shards(parts))).cast("int").alias("shard"))
        rows.sortWithinPartitions("shard", "token", "field", "slug").write.partitionBy("shard").parquet(f"{folder}/postings")
        kept.select("slug").write.parquet(f"{folder}/slugs")
        self.state["parts"] = self.state.get("parts", {}) | {name: parts}
        return name

    def _with(self, segment: str, key: str, only: bool = False) -> IndexEngine:
        kept = [] if only else self.state["segments"]
        state = self.state | {"key": key, "segments": [*kept, segment]}
        storage.write_text(self.spark, f"{self.root}/state/{storage.last_version(self.spark, f'{self.root}/state') + 1:08d}", json.dumps(state))
        engine = IndexEngine(self.spark, self.root, state)
        return engine.merge(key) if len(state["segments"]) > MOST_SEGMENTS else engine

    def add(self, docs: DataFrame, key: str) -> IndexEngine:
        """With documents that are new or take the place of those of their slugs."""
        return self._with(self._segment(docs.select(*self._schema().names)), key)

    def add_batch(self, docs: DataFrame, stream: str, batch: int) -> IndexEngine:
        """``add`` for a batch of a stream: its number names the segment, and the state tells which number was the last, so that a batch
        that comes again, after a failure anywhere in it, changes nothing or is done anew."""
        applied = self.state.get("applied", {})
        if batch <= applied.get(stream, -1):
            return self
        name = self._segment(docs.select(*self._schema().names), f"{stream}-{batch:08d}")
        self.state["applied"] = applied | {stream: batch}
        return self._with(name, self.state["key"])

    def remove(self, slugs: DataFrame, key: str) -> IndexEngine:
        """Without the documents of ``slugs(slug)``; categories and other tables are not touched."""
        name = uuid.uuid4().hex[:12]
        slugs.select("slug").distinct().write.parquet(f"{self.root}/{name}/slugs")
        return self._with(f"-{name}", key)

    def merge(self, key: str | None = None) -> IndexEngine:
        """One segment of all that counts."""
        return self._with(self._segment(self.documents()), key or self.state["key"], only=True)

    def _schema(self):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(self.state["schema"]))

    # tables
    def _live(self, kind: str, schema, folders=None) -> DataFrame:
        """Rows of all segments that later ones don't take the place of; ``folders``: for a segment, those of its folders that are read."""
        segments, parts = self.state["segments"], []
        for i, name in enumerate(segments):
            if name.startswith("-"):
                continue
            base = f"{self.root}/{name}/{kind}"
            paths = [base] if folders is None else [p for f in folders(name) if storage.exists(self.spark, p := f"{base}/{f}")]
            if not paths:
                continue
            rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
            later = [f"{self.root}/{x.lstrip('-')}/slugs" for x in segments[i + 1 :]]
            parts.append(rows.join(self.spark.read.schema("slug string").parquet(*later), "slug", "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        return self._live("documents", self._schema().add("part", IntegerType())).select(*self._schema().names)

    def documents_of(self, slugs: list[str]) -> DataFrame:
        """The documents of some slugs, at most some thousands, out of their folders."""
        if not slugs:
            return self.spark.createDataFrame([], self._schema())
        hashed = dict(local_rows(self.spark, [(x,) for x in slugs], "slug string").select("slug", F.xxhash64("slug")).collect())
        folders = lambda name: [f"part={k}" for k in sorted({hashed[x] % self.state["parts"][name] for x in slugs})]
        rows = self._live("documents", self._schema().add("part", IntegerType()), folders)
        return rows.where(one_of("slug", slugs)).select(*self._schema().names)

    def postings(self) -> DataFrame:
        return self._live("postings", POSTINGS)

    def _postings_of(self, words: list[str]) -> DataFrame:
        """Postings of the shards in which the tokens that ``words`` begin can be; those of a letter are in any."""
        if any(len(w) < HEAD for w in words):
            return self.postings()
        heads = {r[0] for r in local_rows(self.spark, [(w,) for w in words], "w string").select(head_of(F.col("w"))).collect()}
        shards = lambda name: sorted({h % _shards(self.state["parts"][name]) for h in heads})
        return self._live("postings", POSTINGS, lambda name: [f"shard={k}" for k in shards(name)])

    # questions
    def matches(self, wanted: S.Search, categories: DataFrame | None = None) -> DataFrame:
        """As ``search.matches``, the documents without transcript and content."""
        parsed = parse_query(wanted.query)
        light = [n for n in self._schema().names if n not in ("transcript", "content")]
        if parsed.empty or not parsed.index_terms():
            return S.nothing(self.documents().select(*light))
        found = self._found(parsed, wanted.mode)
        docs = self.documents_of([r[0] for r in found])
        if parsed.phrases:
            docs = docs.where(S.membership(parsed, terms=False))
        scores = local_rows(self.spark, found, ", ".join(["slug string", *(f"{f}_score double" for f in S.WEIGHTS)]))
        rows = S.filtered(docs.select(*light), wanted, categories).join(F.broadcast(scores), "slug")  # FIELD_CAP rows a field at most
        return S.scored(rows.withColumn("raw", S.raw_score()))

    def _found(self, parsed, mode: str) -> list:
        """The hits with their scores of fields, but for those that lack a term as a whole word: one scan of the postings.

        A hit of a field is a document in which all words of the query begin tokens of the field (any, under OR), as
        in ``search.field_hits``; whole words may stand in any field.
        """
        words = parsed.index_terms()
        terms = list(dict.fromkeys(t.lower() for t in parsed.terms if re.fullmatch(r"[^\W_]+", t)))
        if parsed.terms and (not terms or (len(terms) < len({t.lower() for t in parsed.terms}) and not parsed.any_term)):
            return []  # a term of other signs is no word of any text
        begins = [F.col("token").startswith(w) for w in words]
        rows = self._postings_of(words).where(reduce(lambda a, b: a | b, begins))
        firsts = {f: [F.min(F.when(b & (F.col("field") == f), F.col("first_pos"))) for b in begins] for f in S.WEIGHTS}
        told = [F.max(F.col("token") == t) for t in terms]
        rows = rows.groupBy("slug").agg(F.array(*(F.struct(F.lit(f).alias("field"), F.array(*p).alias("at")) for f, p in firsts.items())).alias("fields"), F.array(*told, F.lit(True)).alias("told"))
        test = F.exists if parsed.any_term else F.forall
        member = F.exists(F.slice("told", 1, len(terms)), lambda x: x) if parsed.any_term and terms else F.forall("told", lambda x: x)
        hits = rows.select("slug", member.alias("member"), F.explode("fields").alias("h")).where(test("h.at", lambda x: x.isNotNull()))
        best = S.best_of_fields(hits.select("slug", F.struct("slug", "member").alias("of"), "h.field", F.array_min("h.at").alias("first")), named="of")
        # FIELD_CAP rows a field: they are scored here, as ``search.field_scores`` does
        scores: dict[str, dict[str, float]] = {}
        for r in best.where("of.member").select("field", "of.slug", "rank0").collect():
            weight = float(S.WEIGHTS[r["field"]])
            scores.setdefault(r["slug"], {})[r["field"]] = weight if mode == "weighted" else weight / (S.RRF_K + r["rank0"] + 1)
        return [(slug, *(own.get(f) for f in S.WEIGHTS)) for slug, own in sorted(scores.items())]

    def whole(self, rows: DataFrame) -> DataFrame:
        """The rows of a page, at most ``search.PAGE_CAP``, with their texts; read by their slugs."""
        page = rows.collect()
        names = [n for n in ("transcript", "content") if n in self._schema().names]
        kept = local_rows(self.spark, page, rows.schema)
        texts = self.documents_of([r["slug"] for r in page]).select("slug", *names)
        return kept.join(texts, "slug", "left").select(*rows.columns, *names)


def head_of(token: Column) -> Column:
    return F.xxhash64(F.left(token, F.lit(HEAD)))


def _shards(parts: int) -> int:
    return min(SHARDS, SHARDS_A_PART * parts)


def overlap(one, two, queries: list[str], k: int = 5) -> DataFrame:
    """(query, shared, of): how many of their first ``k`` results two engines share, for a stated list of queries."""
    parts = []
    for query in queries:
        wanted = S.Search(query, limit=k)
        tops = [S.page(e.matches(wanted), wanted).select("slug") for e in (one, two)]
        parts.append(tops[0].join(tops[1], "slug", "left_semi").agg(F.lit(query).alias("query"), F.count("*").alias("shared"), F.lit(k).cast("long").alias("of")))
    return reduce(DataFrame.unionByName, parts)
