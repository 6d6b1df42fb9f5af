"""Benchmark decontamination by suffix arrays of the training texts.

Documents are read in shards of some megabytes. A shard's words become numbers and its suffix array
is sorted by prefix doubling, as deep as the longest item. Every suffix of every benchmark item is
then looked up by binary search, all of them side by side: its neighbours in the order give the
longest verbatim match, and the range of suffixes that start with the item's window gives the
places of all occurrences. Items' suffixes so have their places in the order of the shard's, and a place's
neighbours among them tell the longest match that begins there.

Words that no item has share one number that matches nothing, as does the gap between documents; a
suffix that runs into one before the shortest window is over can't hold a window and is left out of
the array.

Bounds. A task holds one shard (a document longer than a shard is a shard by itself) and one block
of items; windows that several items share are looked up once. Items travel in blocks of about ``BLOCK_BYTES`` of text, one after another through the driver; more than one block means
more than one pass over the documents, whose findings are merged. Nothing of the documents is
shuffled but, in that case, the findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import LOWER_TABLE, cut, prepare

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
# A word is a run of ASCII digits and letters and of whatever lies above ASCII.
SPLITS = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))
FOLD = LOWER_TABLE.translate(SPLITS)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Items:
    """A block of benchmark items as numbers, and its suffixes."""

    def __init__(self, rows: list[tuple], window: int) -> None:
        self.ids = sorted({r[0] for r in rows}, key=lambda x: (x is None, x))  # None, of items without an id, last
        at = {x: i for i, x in enumerate(self.ids)}
        texts = [(at[i], w) for i, t in rows if (w := words(t))]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in texts for w in ws}), 2)}
        self.depth = max((len(ws) for _, ws in texts), default=0)
        self.least = min((min(len(ws), window) for _, ws in texts), default=1)
        number = self.vocabulary.__getitem__
        self.flat = np.array([n for _, ws in texts for n in (*map(number, ws), 0)] + [0] * (self.depth + 1), np.int32)
        starts, length, need, item, n = [], [], [], [], 0
        for i, ws in texts:
            size = min(len(ws), window)
            for k in range(len(ws)):
                starts.append(n + k)
                length.append(len(ws) - k)
                need.append(size)
                item.append(i)
            n += len(ws) + 1
        self.starts, self.length, self.need, self.item = (np.array(x, np.int64) for x in (starts, length, need, item))
        #: suffixes that begin with a whole window
        self.windows = np.flatnonzero(self.length >= self.need)
        self._distinct(max((len(ws) for _, ws in texts), default=0))

    def _distinct(self, depth: int) -> None:
        """Each window once, as the suffix ``first`` begins, with the items that have it; and all suffixes in order."""
        rank, step = self.flat[: len(self.flat) - self.depth].astype(np.int64), 1
        most = int(self.need.max(initial=1))
        powers = {1: rank}  # by a width, names that are equal for places with so many words in common
        while step < max(depth, 1):
            after = np.zeros(len(rank), np.int64)
            after[:-step] = rank[step:] if step < len(rank) else 0
            after[rank == rank[-1]] = 0  # nothing counts beyond the gap after an item
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
            step *= 2
            if step <= most:
                powers[step] = rank
        #: place of each suffix in their order, of equal ones by item
        self.order = np.lexsort((np.arange(len(self.starts)), rank[self.starts])) if len(self.starts) else np.zeros(0, np.int64)
        need, start = self.need[self.windows], self.starts[self.windows]
        one, two = np.zeros(len(need), np.int64), np.zeros(len(need), np.int64)
        for width, names in powers.items():
            own = np.flatnonzero((need >= width) & (need < 2 * width))
            one[own], two[own] = names[start[own]], names[start[own] + need[own] - width]
        key = np.stack((need, one, two), 1).reshape(-1, 3)
        _, first, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
        self.first = self.windows[first]
        pairs = np.unique(np.stack((which.reshape(-1), self.item[self.windows]), 1), axis=0)
        self.owners, edges = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.owned = edges  # window w belongs to the items owners[owned[w]:owned[w + 1]]


class Shard:
    """Words of some documents as numbers, 1 where no item has the word and between documents."""

    def __init__(self, texts: list[str | None], items: Items) -> None:
        get = items.vocabulary.get
        pad = [1] * (items.depth + 1)
        flat: list[int] = []
        first = []
        for text in texts:
            first.append(len(flat))
            flat.extend(map(get, words(text), repeat(1)))
            flat.append(1)
        self.first = np.array(first, np.int64)
        self.sizes = np.diff(np.append(self.first, len(flat))) - 1
        self.flat = np.array(flat + pad, np.int32)
        self.order = self._sorted(items.least, items.depth)

    def _sorted(self, least: int, depth: int) -> np.ndarray:
        """The suffix array: starts of suffixes whose first ``least`` words are known, in order."""
        n = len(self.flat)
        stops = np.append(np.flatnonzero(self.flat == 1), n)
        begins = np.concatenate(([0], stops[:-1] + 1))
        runs = stops - begins
        long = runs >= least
        if not depth or not long.any():
            return np.zeros(0, np.int64)
        # Only the long runs are ranked, each with the gap that ends it, laid side by side.
        begins, runs = begins[long], runs[long]
        widths = runs + 1
        base = np.concatenate(([0], np.cumsum(widths)[:-1]))
        where = np.repeat(begins - base, widths) + np.arange(int(widths.sum()))
        rank = self.flat[np.minimum(where, n - 1)].astype(np.int64)
        gap = base + runs
        rank[gap] = 1
        step = 1
        while step < depth:
            after = np.zeros(len(rank), np.int64)
            after[:-step] = rank[step:] if step < len(rank) else 0
            # what lies beyond the gap of the own run counts as nothing
            room = np.repeat(gap, widths) - np.arange(len(rank))
            after[room < step] = 0
            key = rank * (int(rank.max()) + 2) + after
            unique, rank = np.unique(key, return_inverse=True)
            rank = rank + 1
            step *= 2
            if len(unique) == len(rank):
                break
        keep = np.repeat(gap, widths) - np.arange(len(rank)) >= least
        return where[keep][np.argsort(rank[keep], kind="stable")]

    def bounds(self, items: Items, chosen: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chosen item suffix, the range of the array whose suffixes start with its first ``length`` words."""
        return self._search(items, chosen, length, False), self._search(items, chosen, length, True)

    def _search(self, items: Items, chosen: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(chosen), np.int64), np.full(len(chosen), len(self.order), np.int64)
        while len(active := np.flatnonzero(low < high)):
            mid = (low[active] + high[active]) // 2
            sign = self._compare(items, self.order[mid], items.starts[chosen[active]], length[active])
            right = sign < 0 if not after else sign <= 0
            low[active[right]] = mid[right] + 1
            high[active[~right]] = mid[~right]
        return low

    def _compare(self, items: Items, at: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        sign = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for k in range(int(length.max(initial=0))):
            open_ = open_[length[open_] > k]
            if not len(open_):
                break
            apart = self.flat[at[open_] + k].astype(np.int64) - items.flat[start[open_] + k]
            sign[open_] = np.sign(apart)
            open_ = open_[apart == 0]
        return sign

    def common(self, items: Items, at: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words that a text place and an item suffix have in common from their start."""
        same = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for k in range(int(length.max(initial=0))):
            open_ = open_[(length[open_] > k)]
            open_ = open_[self.flat[at[open_] + k] == items.flat[start[open_] + k]]
            if not len(open_):
                break
            same[open_] = k + 1
        return same

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def occurrences(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the shard) of every occurrence of every distinct window."""
        chosen = items.first
        low, high = self.bounds(items, chosen, items.need[chosen])
        found = high - low
        window = np.repeat(np.arange(len(chosen)), found)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found)
        return window, self.order[np.repeat(low, found) + inside]

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item suffix, place, words): for every item suffix that has a match of a window or more, all places of its longest."""
        every = np.arange(len(items.starts))
        if not len(self.order) or not len(every):
            return every[:0], every[:0], every[:0]
        low = self._search(items, every, items.length, False)
        best = np.zeros(len(every), np.int64)
        for side in (np.clip(low - 1, 0, None), np.clip(low, None, len(self.order) - 1)):
            best = np.maximum(best, self.common(items, self.order[side], items.starts, items.length))
        whole = np.flatnonzero(best >= items.need)
        low, high = self.bounds(items, whole, best[whole])
        found = high - low
        inside = np.arange(int(found.sum())) - np.repeat(np.cumsum(found) - found, found)
        return np.repeat(whole, found), self.order[np.repeat(low, found) + inside], np.repeat(best[whole], found)

    def extended(self, items: Items, window: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, words, item suffix) of the longest match that begins at each place where a window occurs."""
        at, first = np.unique(place, return_index=True)
        if not len(at):
            return at, at, at
        # the longest window there is whole in any case; of items shorter than a window none goes on
        turn = np.lexsort((-items.need[items.first[window]], place))
        head = turn[np.concatenate(([True], place[turn][1:] != place[turn][:-1]))]
        suffix = items.first[window[head]]
        words = items.need[suffix].copy()
        low = self._search(items, items.order, items.length[items.order], False)
        rank = np.empty(len(self.flat), np.int64)
        rank[self.order] = np.arange(len(self.order))
        after = np.searchsorted(low, rank[at], side="right")
        for side in (after - 1, after):
            near = items.order[np.clip(side, 0, len(items.order) - 1)]
            same = self.common(items, at, items.starts[near], items.length[near])
            more = (same >= size) & (same > words)
            words[more], suffix[more] = same[more], near[more]
        return at, words, suffix


def _shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows regathered so that each batch holds about ``SHARD_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = [len(t.as_py() or "") for t in batch.column(column)]
        for k, n in enumerate(lengths):
            size += n
            if size >= SHARD_BYTES:
                held.append(batch.slice(at, k + 1 - at))
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, at = [], 0, k + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks of about ``block_bytes``, and the items in blocks, as (id as a string, text), each gathered when
    it is asked for."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1
    deal = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return n, ([tuple(r) for r in rows.where(deal == k).distinct().collect()] for k in range(n))


def _items(bc, window: int) -> Items:
    return Items(bc.value, window)


SPANS = "n_words bigint, hits array<array<bigint>>, items array<string>, longest struct<words:bigint,at:bigint,item:string>"
LISTED = 100_000  # ids of items that a batch of findings holds, more only for one document


def spans(docs: DataFrame, block: list[tuple], id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, n_words, hits, items, longest) of every row of ``docs`` for one block: hits are [start, end) runs
    of hit words, items the ids, as strings in order, of items with an id of which a window occurs, longest the first
    of the longest matches: words, place in the document, and an item."""
    prepare(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(block)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    of_match = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(bc, window)
        for batch in _shards(batches, 1):
            shard = Shard(batch.column(1).to_pylist(), items)
            which, place = shard.occurrences(items)
            room = len(shard.flat) + 1
            edge = np.bincount(place, minlength=room) - np.bincount(place + items.need[items.first[which]], minlength=room)
            hit = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0]))
            turns = np.diff(hit)
            begins, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
            of = shard.document(begins)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for d, a, b in zip(of.tolist(), begins.tolist(), ends.tolist(), strict=True):
                hits[d].append([a - int(shard.first[d]), b - int(shard.first[d])])
            longest: list[dict | None] = [None] * batch.num_rows
            for at, n, suffix in zip(*(x.tolist() for x in shard.extended(items, which, place, window)), strict=True):
                d = int(shard.document(np.int64(at)))
                if longest[d] is None or n > longest[d]["words"]:
                    longest[d] = {"words": n, "at": at - int(shard.first[d]), "item": items.ids[items.item[suffix]]}
            pairs = np.unique(np.stack((shard.document(place), which), 1), axis=0)
            edges = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1))
            found: list[list] = []
            listed, last = 0, 0
            for d in range(batch.num_rows):
                own = [items.owners[items.owned[w] : items.owned[w + 1]] for w in pairs[edges[d] : edges[d + 1], 1]]
                found.append([items.ids[i] for i in np.unique(np.concatenate(own)).tolist() if items.ids[i] is not None] if own else [])
                listed += len(found[-1])
                if listed > LISTED or d == batch.num_rows - 1:
                    part = slice(last, d + 1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[part], pa.array(shard.sizes[part]), pa.array(hits[part], pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string())), pa.array(longest[part], of_match)],
                        ["id", "n_words", "hits", "items", "longest"],
                    )
                    found, listed, last = [], 0, d + 1

    return rows.mapInArrow(run, f"id {kind}, {SPANS}")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, hits, items, longest, contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. longest: the longest verbatim match of a window or more (words, first place, an item), null
    without a hit. Null texts and texts without words have no hits, items without words occur nowhere. The windows of
    items without an id hit like others', but such items are in no list of items, as nothing could name them. Items that share an id count as
    one. Repeated rows get a row each. An empty benchmark hits nothing; no documents: no rows. Other
    columns are not looked at, whatever their names.
    """
    n, blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    if n == 1:
        found = spans(docs, next(blocks), id_col, text_col, window)
    else:
        # Rows of equal id and text have equal findings, so that these name a row.
        digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), F.col(text_col).alias("said"))
        every = None
        for block in blocks:
            part = spans(keyed, block, "key", "said", window)
            every = part if every is None else every.unionByName(part)
        first = F.max(F.struct(F.col("longest.words").alias("words"), (-F.col("longest.at")).alias("back"), F.col("longest.item").alias("item")))
        merged = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), first.alias("l"), (F.count("*") / n).cast("int").alias("n"))
        longest = F.when(F.col("l.words").isNotNull(), F.struct("l.words", (-F.col("l.back")).alias("at"), "l.item"))
        found = merged.withColumn("again", F.explode(F.expr("sequence(1, n)"))).select("id.id", "n_words", _joined("hits").alias("hits"), "items", longest.alias("longest"))
    return found.withColumn("contaminated", F.size("hits") > 0)


def _joined(column: str):
    """Runs in order, those that overlap or touch made one."""
    return F.aggregate(
        F.array_sort(column),
        F.array().cast("array<array<bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(F.element_at(done, -1), 2) >= x[0]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(F.element_at(done, -1), 2), x[1])))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, item_pos, doc_pos, length): for every item suffix and shard, the longest verbatim
    match of a window or more and all its places, positions and length in words.

    Documents and items without words or with a null text match nothing, items without an id match with a null one,
    repeated rows match each; other columns are not looked at. No documents or items: no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sc, out = docs.sparkSession.sparkContext, None
    for block in _blocks(benchmark, item_id, item_text, block_bytes)[1]:
        bc = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            items = _items(bc, window)
            begins = np.flatnonzero(np.diff(items.starts, prepend=-2) != 1)
            for batch in _shards(batches, 1):
                shard = Shard(batch.column(1).to_pylist(), items)
                suffix, place, length = shard.longest(items)
                of = shard.document(place)
                start = begins[np.searchsorted(begins, suffix, side="right") - 1] if len(suffix) else suffix
                ids = pa.array([items.ids[i] for i in items.item[suffix].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), ids, pa.array(suffix - start), pa.array(place - shard.first[of]), pa.array(length)], ["id", "item_id", "item_pos", "doc_pos", "length"])

        part = rows.mapInArrow(run, f"id {kind}, item_id string, item_pos bigint, doc_pos bigint, length bigint")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of an item, columns as they were.

    Each row is judged by its own text, whatever its id; null texts stay. Items without an id count
    like others. Each block of items is a
    pass over the rows that the block before has left, without a shuffle.
    """
    prepare(docs.sparkSession)
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    for block in _blocks(benchmark, item_id, item_text, block_bytes)[1]:
        bc = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            items = _items(bc, window)
            for batch in _shards(batches, at):
                shard = Shard(batch.column(at).to_pylist(), items)
                keep = np.ones(batch.num_rows, bool)
                keep[shard.document(shard.occurrences(items)[1])] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def digest_columns(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, and the SHA-256 of the ids joined by commas."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    longest = [F.coalesce(F.col("longest.words"), F.lit(0)).alias("longest"), F.col("longest.at").alias("longest_at")]
    return found.select("id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated", *longest)
