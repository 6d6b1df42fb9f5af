"""Fielded keyword search: candidates by prefix, membership by whole words, two ways of ranking.

Nothing here is a global sort: each field's hits are the best ``FIELD_CAP`` by a top-k, so that
ranks, scores and pages are worked out over some hundred rows, whatever the corpus. A scan reads the documents
twice: for the hits, and for the columns of the documents that were hit. An engine that keeps an index
(see ``engine``) reads neither.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import ParsedQuery, parse_query
from .deadline import within
from .local import local_rows
from .snippet import with_snippet

# What a hit in a field weighs, and the constant of reciprocal ranks.
WEIGHTS = {"title": 4, "guest": 3, "transcript": 1, "keywords": 3}
RRF_K = 60
FIELD_CAP = 500
PAGE_CAP, PAGE_DEFAULT = 50, 20
DEADLINE_S = 2.0  # a provider of a rerank is waited for so long


@dataclass(frozen=True)
class Search:
    query: str
    mode: str = "weighted"
    limit: int | None = None
    offset: int = 0
    page: int = 0
    guest: str | None = None
    category: str | None = None
    from_date: str | None = None
    to_date: str | None = None

    def window(self) -> tuple[int, int]:
        """(offset, limit): the limit within 1..50, a page before an offset."""
        limit = max(1, min(PAGE_CAP, PAGE_DEFAULT if self.limit is None else self.limit))
        return max(0, (self.page - 1) * limit if self.page > 0 else self.offset), limit


def field_texts() -> dict[str, Column]:
    keywords = F.concat_ws(" ", F.col("keywords"))
    return {"title": F.coalesce("title", "slug"), "guest": F.coalesce("guest", F.lit("")), "transcript": F.coalesce("transcript", F.lit("")), "keywords": F.coalesce(keywords, F.lit(""))}


def field_hits(docs: DataFrame, parsed: ParsedQuery, cap: int = FIELD_CAP) -> DataFrame:
    """(field, slug, rank0) of the hits of all fields: all words of the query begin a word of the field
    (any, under OR), the earliest first, ties by slug, at most ``cap`` a field.

    The documents are read once. Words are only taken out of fields that hold the query's words
    anywhere, and each task passes on no more than its own best ``cap`` of a field.
    """
    words = parsed.index_terms()
    test = (lambda a, b: a | b) if parsed.any_term else (lambda a, b: a & b)
    lower = {f: F.lower(c) for f, c in field_texts().items()}
    may = {f: _all([c.contains(w) for w in words], test) for f, c in lower.items()}
    rows = docs.where(_all(list(may.values()), lambda a, b: a | b))
    rows = rows.select("slug", *(F.when(may[f], T.tokens(c)).alias(f) for f, c in lower.items()))
    places = lambda f: F.array(*(F.array_position(F.transform(f, _begins(w)), True) for w in words))
    rows = rows.select("slug", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), places(f)).alias("at")) for f in lower))).alias("h"))
    rows = rows.select("slug", "h.field", "h.at").where("at is not null")
    hit = F.exists("at", lambda x: x > 0) if parsed.any_term else F.forall("at", lambda x: x > 0)
    first = F.array_min(F.filter("at", lambda x: x > 0))
    return best_of_fields(rows.where(hit).select("field", "slug", first.alias("first")), cap)


def best_of_fields(rows: DataFrame, cap: int = FIELD_CAP, named: str = "slug") -> DataFrame:
    """``rows(field, slug, first)``: the earliest ``cap`` of each field, ties by slug, with rank0; ``named``: the column that is kept of a document."""
    rank = F.row_number().over(Window.partitionBy("field").orderBy("first", "slug"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= cap)
    return best.select("field", named, (F.col("rank") - 1).alias("rank0"))


def _begins(word: str):
    return lambda x: x.startswith(word)


def _all(parts: list[Column], test) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = test(out, p)
    return out


def field_scores(hits: DataFrame, mode: str) -> DataFrame:
    """(slug, a column of score for each field): null where the field has no hit."""
    score = lambda w: F.lit(float(w)) if mode == "weighted" else F.lit(float(w)) / (RRF_K + F.col("rank0") + 1)
    return hits.groupBy("slug").agg(*(F.max(F.when(F.col("field") == f, score(w))).alias(f"{f}_score") for f, w in WEIGHTS.items()))


def raw_score() -> Column:
    """The sum in a fixed order, so that it is the same everywhere."""
    return _all([F.coalesce(F.col(f"{f}_score"), F.lit(0.0)) for f in WEIGHTS], lambda a, b: a + b)


def word_pattern(term: str) -> str:
    return r"(?<![\p{L}\p{N}])" + re.escape(term) + r"(?![\p{L}\p{N}])"


def membership(parsed: ParsedQuery, terms: bool = True) -> Column:
    """Every phrase as a substring of the searchable text; with ``terms`` every term (any, under OR) as a whole word.
    A term with anything but letters and digits in it is no word of any text."""
    fields = field_texts()
    text = T.searchable(*(fields[f] for f in ("title", "guest", "keywords", "transcript")))
    test = F.lit(True)
    for p in parsed.phrases:
        test = test & text.contains(p.lower())
    if parsed.terms and terms:
        each = [text.rlike(word_pattern(t.lower())) if re.fullmatch(r"[^\W_]+", t) else F.lit(False) for t in parsed.terms]
        test = test & _all(each, (lambda a, b: a | b) if parsed.any_term else (lambda a, b: a & b))
    return test


def nothing(docs: DataFrame) -> DataFrame:
    """No results, with the columns of some."""
    return docs.where(F.lit(False)).select(*docs.columns, *(F.lit(None).cast("double").alias(c) for c in (*(f"{f}_score" for f in WEIGHTS), "raw", "score")))


def filtered(rows: DataFrame, search: Search, categories: DataFrame | None) -> DataFrame:
    """Documents by guest, dates (none passes) and category."""
    if search.guest:
        rows = rows.where(F.lower("guest").contains(search.guest.lower()))
    dated = F.coalesce("publish_date", F.lit(""))
    if search.from_date:
        rows = rows.where((dated == "") | (dated >= search.from_date))
    if search.to_date:
        rows = rows.where((dated == "") | (dated <= search.to_date))
    if search.category:
        named = categories.where(F.lower("category_slug").contains(search.category.lower())).select("slug").distinct()
        rows = rows.join(named, "slug", "left_semi")
    return rows


def scored(rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``: raw by the largest raw, to two places. There are at most FIELD_CAP rows a field."""
    rows = rows.withColumn("top", F.max("raw").over(Window.partitionBy()))
    return rows.withColumn("score", F.when(F.col("top") > 0, T.round2(F.col("raw") / F.col("top"))).otherwise(F.col("raw"))).drop("top")


def matches(docs: DataFrame, search: Search, categories: DataFrame | None = None) -> DataFrame:
    """All results of a search by a scan, unordered: the document's columns, field scores, raw and score."""
    parsed = parse_query(search.query)
    if parsed.empty or not parsed.index_terms():
        return nothing(docs)
    found = field_scores(field_hits(docs, parsed), search.mode)
    rows = filtered(docs, search, categories)
    rows = rows.join(F.broadcast(found), "slug").withColumn("raw", raw_score())  # FIELD_CAP rows a field at most
    rows = rows.where(F.when(F.col("raw") >= 0, membership(parsed)))  # by the score too, so that only hits are looked into
    return scored(rows)


def results(source, search: Search, categories: DataFrame | None = None) -> DataFrame:
    """``matches`` of documents or of an engine."""
    return matches(source, search, categories) if isinstance(source, DataFrame) else source.matches(search, categories)


def gathered(rows: DataFrame) -> DataFrame:
    """(slug, score) of all results, which are at most FIELD_CAP a field, worked out once."""
    return local_rows(rows.sparkSession, rows.select("slug", "score").collect(), "slug string, score double")


def results_page(source, search: Search, categories: DataFrame | None = None) -> DataFrame:
    """A page's rows with their texts."""
    rows = page(results(source, search, categories), search)
    return rows if isinstance(source, DataFrame) else source.whole(rows)


def page(found: DataFrame, search: Search) -> DataFrame:
    """The page's rows with their place in the whole order, 1 first; snippets for these alone."""
    offset, limit = search.window()
    best = found.orderBy(F.desc("score"), "slug").limit(offset + limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "slug")))
    return ranked.where(F.col("rank") > offset)


def search(source, wanted: Search, categories: DataFrame | None = None, reranker=None, deadline_s: float = DEADLINE_S) -> DataFrame:
    """rank, slug, title, guest, publish_date, score, source_type, source_id, ranking_mode, snippet.

    ``source``: documents, or an engine over them. ``reranker``: a function of (slug, score) that gives (slug, score, reranked, rank); see
    ``reranked_page``, which waits ``deadline_s`` for it and adds how it went as rerank_attempted, rerank_applied and rerank_reason.
    """
    said = []
    if reranker is None:
        rows = results_page(source, wanted, categories)
    else:
        rows = reranked_page(source, wanted, categories, reranker, deadline_s)
        said = ["rerank_attempted", "rerank_applied", "rerank_reason"]
    rows = with_snippet(rows, "transcript", wanted.query)
    return rows.select(
        "rank", "slug", "title", "guest", "publish_date", "score", F.lit("author").alias("source_type"),
        T.source_id(F.col("author_id"), F.col("slug")).alias("source_id"), F.lit(wanted.mode).alias("ranking_mode"),
        "snippet", *said,
    )


def reranked_page(source, wanted: Search, categories: DataFrame | None, reranker, deadline_s: float = DEADLINE_S) -> DataFrame:
    """The page by the order that ``reranker`` gives all results; if it fails or isn't done by its deadline, by keywords, and the rows say why.

    The results are at most FIELD_CAP a field; their scores are gathered, so that an error of a provider shows here
    and not in the middle of a job of the caller's.
    """
    rows = results(source, wanted, categories)
    kind, scores = "slug string, score double, reranked boolean, rank int", gathered(rows)
    try:
        ask = lambda: reranker(scores).select("slug", "score", "reranked", F.col("rank").cast("int").alias("rank")).collect()
        order = within(rows.sparkSession, deadline_s, ask)
        applied, reason = True, None
    except Exception as e:  # whatever a provider raises leaves the order of the keywords
        window = Window.orderBy(F.desc("score"), "slug")
        order = scores.select("slug", "score", F.lit(False), F.row_number().over(window)).collect()
        applied, reason = False, type(e).__name__
    offset, limit = wanted.window()
    chosen = local_rows(rows.sparkSession, [r for r in order if offset < r[3] <= offset + limit], kind).drop("reranked")
    rows = rows.drop("score").join(F.broadcast(chosen), "slug")
    rows = rows if isinstance(source, DataFrame) else source.whole(rows)
    return rows.withColumns({"rerank_attempted": F.lit(True), "rerank_applied": F.lit(applied), "rerank_reason": F.lit(reason).cast("string")})


def reported_paging(wanted: Search) -> dict:
    """What a response says of its page: the values that the page was made by, also where a page number was given."""
    offset, limit = wanted.window()
    return {"offset": offset, "limit": limit, "page": offset // limit + 1}


def total(source, wanted: Search, categories: DataFrame | None = None) -> DataFrame:
    return results(source, wanted, categories).agg(F.count("*").alias("total"))


def explain(source, wanted: Search, categories: DataFrame | None = None) -> DataFrame:
    """A row for each matched field of each result of the page: raw score, share of the total, evidence."""
    rows = with_snippet(results_page(source, wanted, categories), "transcript", wanted.query)
    evidence = field_texts() | {"transcript": F.col("snippet")}
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_score").alias("field_score"), evidence[f].alias("evidence")) for f in sorted(WEIGHTS)))
    each = rows.select("rank", "slug", "raw", F.explode(F.filter(parts, lambda x: x["field_score"].isNotNull())).alias("p"))
    share = F.when(F.col("raw") > 0, T.round2(F.col("p.field_score") / F.col("raw"))).otherwise(0.0)
    return each.select("rank", "slug", F.col("p.field").alias("field"), F.col("p.field_score").alias("field_score"), share.alias("share"), F.col("raw").alias("raw_score"), F.col("p.evidence").alias("evidence"))


def compare(source, wanted: Search, categories: DataFrame | None = None) -> DataFrame:
    """The two rankings side by side: ranks, their difference, and whether both have the row."""
    sides = []
    for mode, name in (("weighted", "weighted_rank"), ("rrf", "rrf_rank")):
        of = Search(**{**wanted.__dict__, "mode": mode, "limit": 10 if wanted.limit is None else wanted.limit})
        sides.append(page(results(source, of, categories), of).select("slug", F.col("rank").alias(name)))
    both = sides[0].join(sides[1], "slug", "full")
    return both.select("slug", "weighted_rank", "rrf_rank", (F.col("rrf_rank") - F.col("weighted_rank")).alias("rank_delta"), (F.col("rrf_rank").isNotNull() & F.col("weighted_rank").isNotNull()).alias("in_both"))


def postings(docs: DataFrame) -> DataFrame:
    """(field, token, slug, first_pos): the inverted index as a table, for corpora that are searched
    often; write it partitioned by field and sorted by token, and a prefix is a range of it."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), T.tokens(t).alias("tokens")) for f, t in field_texts().items()))
    rows = docs.select("slug", F.explode(each).alias("f")).select("slug", "f.field", F.posexplode("f.tokens").alias("pos", "token"))
    return rows.groupBy("field", "token", "slug").agg((F.min("pos") + 1).alias("first_pos"))
