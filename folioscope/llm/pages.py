"""Main texts of web pages, by removing what a site repeats: its templates.

Every block element's subtree is hashed (names, classes, words). Spark counts for each host in how many different
surroundings a subtree stands, a surrounding being the hash of the parent's subtree; a subtree that recurs in many is the site's, not the
page's, and is deleted from each page. An article's own paragraphs aren't up for deletion, and neither is a subtree that
holds most of a page's text, so copies of an article on one host don't delete it. What can't recur (readers' comments, adverts
that change, sites of few pages) is told by element, role, class or id.

Pages are read twice, once for the hashes and once for the texts, so that only what is left of a page, compressed, is shuffled to the
numbers of the subtrees that go.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pagetree import HEADINGS, INLINE, Page
from .support import cut, prepare

# A template stands in half of a host's pages, but needn't in more than LEAST and a hundredth of them.
LEAST, SHARE = 10, 0.01
SALTS = 16
MENUS = frozenset("ul ol div table section p header".split())
PROSE = frozenset({"p", "blockquote", "pre", "table", "ul", "ol", "dl", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "caption", "figure", "figcaption", "hr"}) | HEADINGS


class Reading:
    """One page: what of it is out, where its content roots are, and which elements are candidates for deletion."""

    def __init__(self, html: str) -> None:
        self.page = page = Page(html)
        tag, parent, n = page.tag, page.parent, len(page.tag)
        self.chars, self.linked = chars, linked = page.sizes()
        self.gone, self.inside = gone, inside = [False] * n, [False] * n
        rooted = [k for k in range(n) if tag[k] in ("article", "main")]
        holds = _upwards(parent, rooted)
        for k in range(1, n):
            gone[k] = gone[parent[k]] or (page.out[k] and not (tag[k] == "form" and k in holds))
        alive = [k for k in rooted if not gone[k]]
        self.roots = roots = set([k for k in alive if tag[k] == "article"] or alive)
        above = _upwards(parent, roots) - roots
        self.candidates = []
        for k in range(1, n):
            up = parent[k]
            inside[k] = inside[up] or k in roots
            if gone[up]:
                gone[k] = True
                continue
            if not roots and not gone[k] and linked[k] * 5 >= chars[k] * 4 > 0 and tag[k] in MENUS and sum(page.tag[x] == "a" for x in _below(page.kids, k)) > 1:
                gone[k] = True  # a menu without a name
            if not chars[k] or tag[k] in INLINE or tag[k] in ("html", "body") or k in above or k in roots:
                continue
            if gone[k] or not (inside[k] and tag[k] in PROSE or chars[k] * 2 > chars[0] and linked[k] * 2 < chars[k]):
                self.candidates.append(k)

    def subtrees(self) -> list[tuple[int, int, int]]:
        """Of each candidate: its number, its hash, and the hash of the nearest block above."""
        made, parent = self.page.hashes(), self.page.parent
        return [(k, made[k], made[_block(parent, made, k)]) for k in self.candidates]

    def out(self) -> int:
        return sum(self.gone[k] and not self.gone[self.page.parent[k]] for k in range(1, len(self.gone)))

    def blocks(self) -> list[tuple[str, list[int]]]:
        """Blocks of text in page order, with the candidates that each lies in."""
        tag, parent, kids, gone = self.page.tag, self.page.parent, self.page.kids, self.gone
        listed = set(self.candidates)
        found: list[tuple[str, list[int]]] = []
        buffer: list[str] = []

        def end(within: tuple[int, ...]) -> None:
            words = " ".join("".join(buffer).split())
            buffer.clear()
            if words:
                found.append((words, list(within)))

        # A walk with a stack of its own: pages may be nested to any depth.
        work: list = [(0, (), False, iter(kids[0]))]
        while work:
            k, within, headed, rest = work[-1]
            # Of a header inside the article only its headings are text.
            kept = (not self.roots or self.inside[k]) and (not headed or _heading_above(tag, parent, k))
            block = tag[k] not in INLINE
            for kid in rest:
                if isinstance(kid, str):
                    if kept:
                        buffer.append(kid)
                elif gone[kid]:
                    if tag[kid] not in INLINE:
                        end(within)
                elif tag[kid] == "br":
                    buffer.append(" ")
                else:
                    if tag[kid] not in INLINE:
                        end(within)
                    work.append((kid, (*within, kid) if kid in listed else within, headed or tag[kid] == "header", iter(kids[kid])))
                    break
            else:
                if block:
                    end(within)
                work.pop()
        return found


def _upwards(parent: list[int], below) -> set[int]:
    """Elements with all that they lie in."""
    found = set()
    for k in below:
        while k >= 0 and k not in found:
            found.add(k)
            k = parent[k]
    return found


def _below(kids: list, k: int) -> Iterator[int]:
    work = [k]
    while work:
        below = [x for x in kids[work.pop()] if not isinstance(x, str)]
        yield from below
        work += below


def _block(parent: list[int], made: list[int], k: int) -> int:
    """The nearest block above: inline elements have no hash of their own."""
    k = parent[k]
    while k > 0 and not made[k]:
        k = parent[k]
    return k


def _heading_above(tag: list[str], parent: list[int], k: int) -> bool:
    while k > 0 and tag[k] != "header":
        if tag[k] in HEADINGS:
            return True
        k = parent[k]
    return False


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows with a key of all they hold, and their host: rows of one key are the same row."""
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    html, url = F.col(html_col).cast("string"), F.lower(F.col(url_col).cast("string"))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html, F.lit("")).alias("html"), F.unhex(F.md5(F.concat_ws("\n", said(id_col), said(url_col), said(html_col)).cast("binary"))).alias("key"),
        F.when(F.coalesce(host, F.lit("")) != "", F.xxhash64(host)).alias("host"),
    )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "host", "element", "subtree", "around"]
    for batch in batches:
        columns = [[], [], [], [], []]
        for key, host, html in zip(*(batch.column(i) for i in range(3)), strict=True):
            found = Reading(html.as_py()).subtrees()
            size = len(html.as_py().encode("utf-8", "surrogatepass"))
            # The page itself, as element 0 in surroundings of its own: these count a host's pages.
            for row in ((0, 0, zlib.crc32(key.as_py()) << 31 ^ size), *found):
                for column, value in zip(columns, (key.as_py(), host.as_py(), *row), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)


def templates(pages: DataFrame, least: int = LEAST, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, element): the elements of each page that recur in many of the host's pages.

    A subtree of n different surroundings goes if n is 2 at least, and half of the host's pages or ``least`` and ``share`` of them, whichever is less.
    Pages whose url is null or has no host have no site, and repeated rows are one page.
    """
    rows = _keyed(pages, id_col, url_col, html_col).where("host is not null").select("key", "host", "html")
    found = cut(rows.mapInArrow(_candidates, "key binary, host bigint, element int, subtree bigint, around bigint"))
    seen = found.groupBy("host", "subtree", "around").agg(F.lit(1).alias("one")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    total = seen.where("subtree = 0").select("host", F.col("n").alias("pages"))
    enough = F.greatest(F.lit(2), F.least(F.ceil(F.col("pages") / 2), F.lit(least) + F.ceil(F.col("pages") * share)))
    many = seen.where("subtree <> 0 and n > 1").join(total, "host").where(F.col("n") >= enough).select("host", "subtree", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.where("subtree <> 0").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(many, ["host", "subtree", "salt"], "left_semi").select("key", "element")


def extracted(pages: DataFrame, least: int = LEAST, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text (blocks joined by line feeds; empty if nothing is left), n_chars, n_template
    (subtrees deleted since they recur on the host) and n_out (deleted by what they are).

    Null html counts as empty, with an empty text. Null and odd urls belong to no host: such pages lose only what is told by what it is.
    Repeated rows come out repeated, each with the same text; ids may be null or equal. Pages of any length and depth are read whole.
    Other columns aren't looked at. No rows: no rows.
    """
    prepare(pages.sparkSession)
    going = templates(pages, least, share, id_col, url_col, html_col).groupBy("key").agg(F.collect_set("element").alias("going"))
    rows = _keyed(pages, id_col, url_col, html_col).select("id", "url", "key", "html")
    kind = rows.schema["id"].dataType.simpleString()
    url_kind = rows.schema["url"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, out = [], []
            for html in batch.column(3):
                page = Reading(html.as_py())
                packed.append(zlib.compress(json.dumps(page.blocks()).encode(), 1))
                out.append(page.out())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary()), pa.array(out, pa.int32())], ["id", "url", "key", "packed", "n_out"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for packed, going in zip(batch.column(2), batch.column(4), strict=True):
                gone = set(going.as_py() or ())
                texts.append("\n".join(words for words, within in json.loads(zlib.decompress(packed.as_py())) if gone.isdisjoint(within)))
                counts.append(len(gone))
            text = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int32()), batch.column(3)], ["id", "url", "text", "n_chars", "n_template", "n_out"])

    packed = rows.mapInArrow(pack, f"id {kind}, url {url_kind}, key binary, packed binary, n_out int")
    whole = packed.join(going, "key", "left").select("id", "url", "packed", "n_out", "going")
    return whole.mapInArrow(unpack, f"id {kind}, url {url_kind}, text string, n_chars bigint, n_template int, n_out int")
