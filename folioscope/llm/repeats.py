"""Suffix-array dedup: byte strings of ``LENGTH`` bytes or more that occur more than once.

What is removed are strings of ``LENGTH`` bytes. Passages of prose of more than ``WORDS`` words are often
shorter, so that the same scan also tells of strings of ``SHORT`` bytes; nothing is removed for these.

Anchors. In each stretch of ``SHORT`` bytes the ``GRAM``-byte string with the least hash is its
anchor, so equal stretches have an anchor at the same place in them, and about one position in 100 is
an anchor. A string of ``LENGTH`` bytes has the anchor of its first stretch. Anchors whose string occurs nowhere else can be in no repeat and are left out.

Suffix arrays. The other anchors go, with the bytes to their right and left, to the task of their
string. There their suffixes are sorted and the lengths of common prefixes are scanned with a stack,
which gives the tree of common-prefix intervals. In each interval the members are sorted by what lies
to their left and scanned in the same way: an interval of common left extensions whose members differ
in the next byte on the left, and lie in more than one child on the right, is a maximal repeat with
all its occurrences.

Hot anchors. A string with more than ``HOT`` anchors (a passage in a third of all texts) is dealt out
in groups by the hash of all that the anchor stands for. A task that meets the same surroundings again
knows both for covered and sends them no further but once. What such a group can't find by itself, a stretch whose like is in another group,
is found by an exact count: each group hands on the stretches it left alone, and one example of each
of its repeats, and those of all groups are compared by hashes of what ever fewer stretches have in
common: 42, 6 and 1 at a time.

Bounds. Equal texts are looked at once; a text of ``LENGTH`` bytes or more that stands twice is
repeated throughout. Texts are read in segments of 60,000 bytes; a task of the scan holds some
thousand anchors with at most 592 bytes each, and remembers at most ``SEEN`` texts' digests and surroundings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import prepare

LENGTH = 400  # what is removed
SHORT = 256  # what is told of besides
WORDS = 50  # a passage has more
GRAM = 64
HOT = 4096
SEGMENT = 60_000
GATHER = 4096
WIDTHS = (42, 6, 1)

_rng = np.random.default_rng(20240101)
_TABLE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(1 << 62, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder, and read from there."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/folioscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position that has so many (``GRAM`` is a power of two)."""
    h, step, level = _TABLE[data], 1, 0
    while step < GRAM:
        h = h[:-step] * _FACTORS[level] + h[step:]
        step, level = step * 2, level + 1
    h = h ^ (h >> np.uint64(29))
    return h * _FACTORS[7]


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, position, lo, hi, gram) of the anchors of some texts laid side by side: the anchor at a
    position is that of the stretches which begin hi to lo bytes before it. All texts together have
    at most 65,535 bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    n_windows = len(data) - length + 1
    if n_windows < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = gram_hashes(data)
    key = (grams & ~np.uint64(0xFFFF)) | np.arange(len(grams), dtype=np.uint64)
    low, width, span = key, 1, length - GRAM + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & np.uint64(0xFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = owner[:n_windows] == owner[length - 1 :]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    own = at[starts]
    turn = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[turn], starts[np.concatenate((turn[1:] - 1, [len(starts) - 1]))]
    place = own[turn]
    text = owner[place]
    return text, place - begins[text], place - last, place - first, grams[place].astype(np.int64)


def text_anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of texts of any length, in segments that overlap by less than a stretch."""
    packed, which, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if size + len(text) > SEGMENT and packed:
            yield _moved(anchors(packed, length), which, [0] * len(which))
            packed, which, size = [], [], 0
        if len(text) > SEGMENT:
            for at in range(0, len(text) - length + 1, SEGMENT - length + 1):
                yield _moved(anchors([text[at : at + SEGMENT]], length), [i], [at])
            continue
        packed.append(text)
        which.append(i)
        size += len(text)
    if packed:
        yield _moved(anchors(packed, length), which, [0] * len(which))


def _moved(found: tuple[np.ndarray, ...], which: list[int], by: list[int]) -> tuple[np.ndarray, ...]:
    text, place, lo, hi, gram = found
    return np.array(which, np.int64)[text], place + np.array(by, np.int64)[text], lo, hi, gram


def _rows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of a matrix, filled up with zeros, and their lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), int(lengths.max(initial=0)) + 1), np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    rows = np.repeat(np.arange(len(strings)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


def _common(matrix: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes of rows ``a`` and ``b``."""
    if not len(a):
        return np.zeros(0, np.int64)
    apart = matrix[a] != matrix[b]
    same = np.where(apart.any(1), apart.argmax(1), matrix.shape[1])
    return np.minimum(same, np.minimum(lengths[a], lengths[b]))


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The tree of common-prefix intervals by a scan with a stack: (length, first, last), children
    before parents. ``common[i]``: what rows i and i + 1 of the sorted order have in common."""
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > c:
            length, first = stack.pop()
            yield length, first, i
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append((c, first))


def _pair(rights: list[bytes], lefts: list[bytes]) -> tuple[int, int]:
    """How far two anchors of one string agree to the left and to the right."""
    ends = []
    for one, two in (lefts, rights):
        n = min(len(one), len(two))
        ends.append(n if one[:n] == two[:n] else next(k for k in range(n) if one[k] != two[k]))
    return ends[0], ends[1]


def _tree(rights: list[bytes], lefts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(right length, members in order of what lies to their left, child of each, common left lengths) of
    the intervals in which a repeat of ``least`` bytes can be, children before parents."""
    order = np.array(sorted(range(len(rights)), key=rights.__getitem__))
    matrix, lengths = _rows(rights)
    common = _common(matrix, lengths, order[:-1], order[1:])
    outward, widths = _rows(lefts)
    rank = np.empty(len(rights), np.int64)
    rank[sorted(range(len(rights)), key=lefts.__getitem__)] = np.arange(len(rights))
    for length, first, last in intervals(common.tolist()):
        members = order[first : last + 1]
        if length + int(widths[members].max()) < least:
            continue
        child = np.zeros(len(members), np.int64)
        child[1:] = np.cumsum(common[first:last] == length)
        turn = np.argsort(rank[members])
        members, child = members[turn], child[turn]
        beside = _common(outward, widths, members[:-1], members[1:])
        if length + int(beside.max()) >= least:
            yield length, members, child, beside


def maximal(rights: list[bytes], lefts: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left length, right length, members) of the maximal repeats of ``least`` bytes or more among
    anchors of one string, ``lefts`` read from the anchor outwards."""
    for length, members, child, beside in _tree(rights, lefts, least):
        for left, a, b in intervals(beside.tolist()):
            if length + left >= least and (child[a : b + 1] != child[a]).any():
                yield left, length, members[a : b + 1]


def reached(rights: list[bytes], lefts: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(right length, members, left lengths, examples): for each interval, how far to the left its longest
    maximal repeat reaches from each member (-1: there is none), and (left length, member) of one member of
    each repeat that holds no longer one."""
    if len(rights) == 2:
        left, right = _pair(rights, lefts)
        if left + right >= least:
            yield right, np.arange(2), np.full(2, left), [(left, 0)]
        return
    for length, members, child, beside in _tree(rights, lefts, least):
        far, examples = np.full(len(members), -1), []
        for left, a, b in intervals(beside.tolist()):
            if length + left >= least and (child[a : b + 1] != child[a]).any():
                own = far[a : b + 1]
                bare = own < 0  # children come first, and reach farther
                if bare.all():
                    examples.append((left, int(members[a])))
                own[bare] = left
        if examples:
            yield length, members, far, examples


def _runs(lo: int, hi: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of lo..hi is in none of the ranges."""
    out, at = [], lo
    for a, b in sorted(covered):
        if a > at:
            out.append((at, min(a - 1, hi)))
        at = max(at, b + 1)
        if at > hi:
            break
    if at <= hi:
        out.append((at, hi))
    return [(a, b) for a, b in out if a <= b]


CONTEXT = "gram bigint, salt int, hot boolean, tid binary, pos bigint, lo int, hi int, before binary, after binary, room int"
SEEN = 50_000  # texts and surroundings that a task remembers; it forgets them when there are more
FOUND = "kind int, tid binary, pos bigint, lo int, hi int, piece binary"
# Each kind plus the length of its strings; a cover of LENGTH is one of SHORT as well.
COVER, LEFT, EXAMPLE = 1000, 2000, 3000


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
    """Whole groups of rows of one (gram, salt), some thousand rows at a time, each (tid, pos) once."""
    held: list[list[tuple]] = []
    key, size = None, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if size >= GATHER:
                    yield held
                    held, size = [], 0
                held.append([])
                key = row[:2]
            held[-1].append(row)
            size += 1
    if held:
        yield held


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (owner, first, last) in order, those of one owner that overlap or adjoin made one."""
    owner, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    turn = np.lexsort((first, owner))
    owner, first, last = owner[turn], first[turn], last[turn]
    apart = owner * 4 * LENGTH  # so that no range of one owner meets another's
    upto = np.maximum.accumulate(last + apart)
    begins = np.flatnonzero(np.concatenate(([True], (first + apart)[1:] > upto[:-1] + 1)))
    return owner[begins], first[begins], (upto - apart)[np.concatenate((begins[1:] - 1, [len(owner) - 1]))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs; of hot anchors also the stretches that no other of the group has, and examples.

    All of it for strings of ``LENGTH`` and of ``SHORT`` bytes, out of one scan."""
    for groups in _groups(batches):
        out: list[tuple] = []
        for group in groups:
            if group[0][7] is None:  # met the same surroundings elsewhere: covered by all its stretches
                for _, _, _, tid, pos, lo, hi, _, _, room in group:
                    out.append((COVER + SHORT, tid, pos, lo, hi, None))
                    if (first := max(lo, LENGTH - room)) <= hi:
                        out.append((COVER + LENGTH, tid, pos, first, hi, None))
                continue
            rows = list({(r[3], r[4], r[5], r[6]): r for r in group}.values())
            hot = rows[0][2]
            parts: dict[int, list] = {SHORT: [], LENGTH: []}
            for right, members, far, examples in reached([r[8] for r in rows], [r[7] for r in rows], SHORT) if len(rows) > 1 else ():
                for n, found in parts.items():
                    held = np.flatnonzero((far >= 0) & (far + right >= n))
                    if len(held):
                        found.append((members[held], np.full(len(held), n - right), far[held]))
                    for left, m in examples if hot else ():
                        if left + right >= n:
                            _, _, _, tid, pos, _, _, before, after, _ = rows[m]
                            first = max(0, n - right)
                            out.append((EXAMPLE + n, tid, pos, first, left, before[:left][::-1] + after[: n - first]))
            for n, found in parts.items():
                covered: list[list[tuple[int, int]]] = [[] for _ in rows] if hot else []
                for m, a, b in zip(*(x.tolist() for x in _joined(found)), strict=True) if found else ():
                    out.append((COVER + n, rows[m][3], rows[m][4], a, b, None))
                    if hot:
                        covered[m].append((a, b))
                for r, ranges in zip(rows, covered, strict=True) if hot else ():
                    _, _, _, tid, pos, lo, hi, before, after, _ = r
                    out += [(LEFT + n, tid, pos, a, b, before[:b][::-1] + after[: n - a]) for a, b in _runs(max(lo, n - len(after)), hi, ranges)]
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "tid", "pos", "lo", "hi", "piece"])


def _halved(width: int, length: int):
    """Splits rows (kind, tid, pos, lo, hi, piece) into ranges of ``width`` stretches; ``same`` is the
    hash of what all stretches of the range have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, hashes = [], []
            for kind, tid, pos, lo, hi, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in range(lo // width, hi // width + 1):
                    first, last = part * width, part * width + width - 1
                    a, b = max(lo, first), min(hi, last)
                    core = piece[max(0, hi - first) : hi + length - last]  # piece begins hi bytes before the anchor
                    out.append((kind, tid, pos, a, b, piece[hi - b : hi + length - a]))
                    hashes.append(xxhash.xxh3_128_digest(core, seed=part))
            if out:
                whole = _batch(out)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *whole.columns], ["same", *whole.schema.names])

    return run


def _across(found: DataFrame, length: int) -> DataFrame:
    """Covered stretches (tid, pos, lo, hi) of ``length`` bytes whose like is in another group of a hot anchor's."""
    rows = found.where(F.col("kind").isin(LEFT + length, EXAMPLE + length))
    for width in WIDTHS:
        split = stored(rows.mapInArrow(_halved(width, length), "same binary, " + FOUND))
        place = F.struct("tid", "pos")
        met = split.groupBy("same").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min("kind").alias("k")).where((F.col("a") != F.col("b")) & (F.col("k") == LEFT + length))
        rows = split.join(met.select("same"), "same", "left_semi").drop("same")
    return rows.where(F.col("kind") == LEFT + length).select("tid", "pos", "lo", "hi")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("__text", text.cast("binary"))


def _tid():
    return F.unhex(F.substring(F.sha2("__text", 256), 1, 32))


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts, tids = [], []
            for t in batch.column(0).to_pylist():
                if len(t) < length:
                    continue
                tid = hashlib.sha256(t).digest()[:16]
                if tid not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(tid)
                    texts.append(t)
                    tids.append(tid)
            names = pa.array(tids, pa.binary())
            for text, place, lo, hi, gram in text_anchors(texts, length):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(text)), pa.array(place), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(gram)], ["tid", "pos", "lo", "hi", "gram"])

    return run


ANCHOR = "tid binary, pos bigint, lo int, hi int, gram bigint"


def _contexts(hot: int):
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of surroundings that are forgotten and met again, a row more goes to the group, where it is found.
        seen: dict[tuple, tuple | None] = {}
        texts: set[bytes] = set()
        for batch in batches:
            for tid, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tid in texts:  # a repeated row; if it is forgotten, its text goes whole in any case
                    continue
                if len(texts) >= SEEN:
                    texts.clear()
                texts.add(tid)
                rows: list[tuple] = []
                for a in found:
                    pos, lo, hi, gram = a["pos"], a["lo"], a["hi"], a["gram"]
                    parts = -(-a["n"] // hot)
                    before, after = text[pos - hi : pos][::-1], text[pos : pos + LENGTH - lo]
                    if parts == 1:
                        rows.append((gram, 0, False, tid, pos, lo, hi, before, after, len(after)))
                    else:
                        digest = xxhash.xxh3_128_intdigest(before + after, seed=hi)
                        key = (gram, lo, digest)
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen[key] = (tid, pos, lo, hi)
                            rows.append((gram, digest % parts, True, tid, pos, lo, hi, before, after, len(after)))
                        else:
                            for other in filter(None, (seen[key], (tid, pos, lo, hi))):
                                rows.append((gram, -1 - (other[0][0] * 16 + other[1]) % 4096, True, *other, None, None, len(after)))
                            seen[key] = None
                    if len(rows) >= GATHER:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


class Prepared:
    """The tables that the operator's results are made of."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, hot: int = HOT) -> None:
        prepare(docs.sparkSession)
        self.rows = _texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")), "__t").drop("__t")
        found = stored(self.rows.select("__text").mapInArrow(_anchored(SHORT), ANCHOR))
        # a string whose least and greatest place agree stands nowhere else, in however many equal texts
        place = F.xxhash64("tid", "pos")
        often = stored(found.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("gram"))
        repeated = stored(found.join(often, "gram", "left_semi").distinct())
        heavy = stored(repeated.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot))
        anchor = F.struct("pos", "lo", "hi", "gram", F.coalesce("n", F.lit(1)).alias("n"))
        lists = repeated.join(heavy, "gram", "left").groupBy("tid").agg(F.collect_list(anchor).alias("found"))
        self.small = self.rows.select("id", _tid().alias("tid"), F.octet_length("__text").cast("long").alias("n_bytes"), F.sha2("__text", 256).alias("sha256"))
        self.copies = self.small.groupBy("tid").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        chosen = lists.join(self.copies, "tid")
        texts = self.rows.withColumn("__tid", _tid())
        met = texts.join(chosen, texts["id"].eqNullSafe(chosen["first"]) & (texts["__tid"] == chosen["tid"]))
        #: (tid, text, found, copies) of each distinct text with a repeated anchor
        self.texts = stored(met.select("tid", F.col("__text").alias("text"), "found", "copies"))
        self.context = self.texts.select("tid", "text", "found").mapInArrow(_contexts(hot), CONTEXT).repartition("gram", "salt").sortWithinPartitions("gram", "salt")


def _spans(size: int, ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of the bytes that ranges (start, end) cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, ranges[:, 0], 1)
    np.add.at(edge, ranges[:, 1], -1)
    turns = np.diff(np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0])))
    return np.stack((np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)), 1)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = pa.list_(pa.list_(pa.int64()))
    for batch in batches:
        out = []
        for tid, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            places = np.array([(r["length"], r["pos"] - r["hi"], r["pos"] - r["lo"] + r["length"]) for r in ranges], np.int64)
            spans = _spans(len(text), places[places[:, 0] == LENGTH, 1:])
            said = [[a, b] for a, b in _spans(len(text), places[:, 1:]).tolist() if len(text[a:b].split()) > WORDS]
            kept, at = [], 0
            for a, b in spans.tolist():
                kept.append(text[at:a])
                at = b
            out.append((tid, spans.tolist(), said, b"".join([*kept, text[at:]])))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], runs), pa.array(columns[2], runs), pa.array(columns[3], pa.binary())], ["tid", "spans", "passages", "kept"])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, sha256, spans (removed [start, end) runs of bytes),
    passages and kept_sha256.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in this row or
    another; strings are judged on the input. ``passages`` only tells: it has the runs of bytes covered in
    the same way by strings of ``SHORT`` bytes, those of more than ``WORDS`` words (parts of words at either end
    count); a text of ``SHORT`` bytes that stands twice is a passage, whole. Null texts are empty ones; texts shorter than ``SHORT``
    stay whole and have none; repeated rows are copies of each other and go. Ids are passed on, null and repeated ones
    too; other columns are not looked at, whatever their names. No rows: no rows.
    """
    made = Prepared(docs, id_col, text_col, hot)
    found = stored(made.context.mapInArrow(_scan, FOUND))
    length = (F.col("kind") - COVER).alias("length")
    covers = found.where(F.col("kind") < LEFT).select("tid", "pos", "lo", "hi", length)
    if not found.where(F.col("kind") > LEFT).isEmpty():
        for n in (LENGTH, SHORT):
            covers = covers.unionByName(_across(found, n).withColumn("length", F.lit(n)))
    lists = covers.groupBy("tid").agg(F.collect_list(F.struct("pos", "lo", "hi", "length")).alias("ranges"))
    single = made.texts.where("copies = 1").select("tid", "text").join(lists, "tid")
    kind = "array<array<bigint>>"
    parts = single.mapInArrow(_cleaned, f"tid binary, spans {kind}, passages {kind}, kept binary").select("tid", "spans", "passages", F.sha2("kept", 256).alias("kept_sha256"))
    out = made.small.join(made.copies.select("tid", "copies"), "tid").join(parts, "tid", "left")
    twice = lambda least: (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    all_of_it = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    nothing = F.array().cast(kind)
    spans = F.when(twice(LENGTH), all_of_it).otherwise(F.coalesce("spans", nothing))
    passages = F.when(twice(SHORT), all_of_it).otherwise(F.coalesce("passages", nothing))
    kept = F.when(twice(LENGTH), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256"))
    return out.select("id", "n_bytes", "sha256", spans.alias("spans"), passages.alias("passages"), kept.alias("kept_sha256"))


WIDE = "gram bigint, tid binary, pos bigint, lo int, hi int, copies bigint, before binary, after binary"
REPEAT = "number binary, length bigint, tid binary, start bigint, pos bigint, lo int, hi int, gram bigint"


def _named(rows: list[tuple], kind: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in kind.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _wide(width: int):
    """Anchors with ``width`` bytes to the right, and to the left one more than their stretches reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, copies, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                each = max(1, (1 << 23) // width)
                for at in range(0, len(found), each):
                    part = [(a["pos"], a["lo"], a["hi"], a["gram"]) for a in found[at : at + each]]
                    yield _named([(g, tid, p, lo, hi, copies, text[max(0, p - hi - 1) : p][::-1], text[p : p + width]) for p, lo, hi, g in part], WIDE)

    return run


def _repeats(width: int, prior: int):
    """Maximal repeats whose first stretch is the anchor's and that end ``prior`` bytes right of it or
    later; those that reach ``width`` bytes have no number: their anchors have to be seen with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            rows = [r for r in held for _ in range(min(r[5], 2))]  # a text that stands twice meets itself
            out = []
            for left, right, members in maximal([r[7] for r in rows], [r[6] for r in rows]) if len(rows) > 1 else ():
                _, _, _, lo, hi, _, before, after = rows[int(members[0])]
                if right < prior or not lo <= left <= hi:
                    continue
                number = None if right == width else xxhash.xxh3_128_digest(before[:left][::-1] + after[:right])
                for r in {(rows[m][1], rows[m][2]): rows[m] for m in members.tolist()}.values():
                    out.append((number, left + right, r[1], r[2] - left, r[2], r[3], r[4], gram))
                if len(out) >= GATHER:
                    yield _named(out, REPEAT)
                    out = []
            if out:
                yield _named(out, REPEAT)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != gram:
                    yield from close()
                    gram, held = row[0], []
                held.append(row)
        yield from close()

    return run


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(length, occurrences): every maximal repeat of ``LENGTH`` bytes or more, of any length, with all its
    occurrences (id, start byte), those in equal texts too. Texts' ends count as unlike any byte.

    A repeat is found by the anchor of its first stretch alone, so what lies to the left is bounded. To the
    right, anchors whose repeats reach the end of what was looked at are looked at again, twice as far. All
    anchors of one string are held by one task, however many, and occurrences are listed for each repeat:
    where repeats lie in one another, as in a long run of one byte, they grow with the square of its length.

    Null and short texts repeat nothing; ids are told as they are, null and repeated ones too, each row's occurrences by themselves. No rows: no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = _texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")), "__t").drop("__t").withColumn("tid", _tid())
    small = stored(rows.where(F.octet_length("__text") >= LENGTH).select("id", "tid"))
    copies = stored(small.groupBy("tid").agg(F.count("*").alias("copies")))
    found = rows.select("__text").mapInArrow(_anchored(LENGTH), ANCHOR)
    found = stored(found.groupBy("tid", "pos", "gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    often = found.join(copies, "tid").groupBy("gram").agg(F.sum("copies").alias("n")).where("n > 1")
    active = stored(found.join(often.select("gram"), "gram", "left_semi"))
    texts = rows.join(active.select("tid").distinct(), "tid", "left_semi").groupBy("tid").agg(F.first("__text").alias("text"))
    texts = stored(texts.join(copies, "tid"))
    each, width, prior = None, LENGTH, 0
    while each is None or not active.isEmpty():
        lists = active.groupBy("tid").agg(F.collect_list(F.struct("pos", "lo", "hi", "gram")).alias("found"))
        wide = texts.join(lists, "tid").select("tid", "text", "copies", "found").mapInArrow(_wide(width), WIDE)
        seen = stored(wide.repartition("gram").sortWithinPartitions("gram").mapInArrow(_repeats(width, prior), REPEAT))
        active = seen.where("number is null").select("tid", "pos", "lo", "hi", "gram").distinct()
        done = seen.where("number is not null").select("number", "length", "tid", "start")
        each = done if each is None else each.unionByName(done)
        width, prior = 2 * width, width
    named = each.join(small, "tid")
    return named.groupBy("number", "length").agg(F.array_sort(F.collect_list(F.struct("id", "start"))).alias("occurrences")).drop("number")
