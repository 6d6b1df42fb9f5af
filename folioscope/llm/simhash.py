"""SimHash near-duplicates, candidates found by the pigeonring principle.

A fingerprint of 64 or 128 bits is cut into ``radius + 1`` consecutive segments on a ring. If two
fingerprints differ in at most ``radius`` bits, there is a segment from which every run of
1, 2, 3, ... consecutive segments has no more differing bits than its proportional share of the
radius (Qin and Xiao, "Pigeonring", VLDB 2018): 0 bits in the first, at most 1 in the first two,
and so on. Candidates are met on a key of the first two segments: each fingerprint stands under
its own two segments and under those with one zero bit of the second set to one (of two values
that differ in one bit, one holds the zero). Candidates are then held to the longer runs, and last
to the whole distance.

Bounds. Equal fingerprints are one node, so copies cost one row. A key's rows are streamed in key
order. Groups of more than ``SMALL`` rows link by a search that takes each node out once (links no
more than nodes, never all pairs); rows that stand there by a bit set are linked among each other
under their own key, so that one link joins each tree of them. Groups of more than ``HOT`` rows are
passed on and met again on keys of three segments, of which there are 256 times as many or more; what is
crowded even then, near copies by the thousand, is dealt out as pairs of blocks of ``HOT`` rows, of which each gives what joins the two.
No link is lost in either way, and all pairs are held to the chains before the whole distance.

``keep_one`` takes the components of such links for groups of candidates only, and looks at the
shingles of all pairs of a group; see ``confirmed``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .support import LOWER_TABLE, cut, prepare

HOT = 4096  # rows of one key that a task holds; more are dealt out in blocks
SMALL = 32  # up to so many rows of a key, all pairs are looked at in one vector step
CHUNK = 1 << 15  # shingles hashed at a time, so that a very long text needs no more memory
HELD = 256  # texts of a block whose shingles are compared; larger groups are dealt out in blocks
SHINGLE = 5  # words
ALIKE = 0.8
FLUSH = 200_000  # nodes that a task's union-find holds before it hands out its stars


def text_fingerprint(text: str | None, size: int = 4, width: int = 64, seed: int = 42) -> str:
    """Hex digits of the fingerprint of one text. ``width`` 64: ``size``-word shingles, repeats
    included, hashed by XXH64. ``width`` 128: distinct shingles, hashed by XXH3's 128 bits."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    if not words:
        return "0" * (width // 4)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    elif size == 1:
        shingles = words
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
        shingles = [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    counts = np.zeros(width, np.int64)
    if width == 64:
        digest = xxhash.xxh64_digest
    else:
        shingles = list(set(shingles))
        digest = xxhash.xxh3_128_digest
    for at in range(0, len(shingles), CHUNK):
        raw = b"".join([digest(s, seed) for s in shingles[at : at + CHUNK]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, width // 8), axis=1)
        for part in range(0, len(bits), 255):  # sums of 255 rows stay within a byte
            counts += bits[part : part + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles)).tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, width: int = 64, extra: list | None = None, counted: bool = False) -> DataFrame:
    """(id, fingerprint, *extra) for every row of ``docs``, repeated rows included.

    Null and blank texts get a fingerprint of zeros. ``extra``: columns to carry along. ``counted``:
    a last column with the ``counted_fingerprint``.
    """
    prepare(docs.sparkSession)
    extra = extra or []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    names = ["id", *rows.columns[2:]]
    added = ["fingerprint", "counted"] if counted else ["fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [pa.array([text_fingerprint(t.as_py(), size, width) for t in texts], pa.string())]
            if counted:
                found.append(pa.array([counted_fingerprint(t.as_py(), width) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, *added])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), *(f"{n} string" for n in added)]))


def _unhex(column: pa.Array, width: int) -> np.ndarray:
    raw = bytes.fromhex("".join(column.to_pylist()))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, width // 64)


class Ring:
    """The segments of fingerprints of ``width`` bits for a radius."""

    def __init__(self, width: int, radius: int) -> None:
        self.width, self.radius, self.segments, words = width, radius, radius + 1, width // 64
        if width not in (64, 128) or self.segments < 3 or self.segments % words:
            raise ValueError("width must be 64 or 128, and radius + 1 at least 3 and a multiple of width / 64")
        each = self.segments // words
        cuts = [round(64 * i / each) for i in range(each + 1)]
        #: word, lowest bit, number of bits of each segment
        self.parts = [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]
        if max(x[2] for x in self.parts) > 28:
            raise ValueError("the radius is too small for this width")

    def value(self, prints: np.ndarray, i: int) -> np.ndarray:
        word, low, bits = self.parts[i % self.segments]
        return (prints[:, word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)

    def keys(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, whether a bit was set in them, and the row of ``prints`` of each."""
        keys, flipped, rows = [], [], []
        every = np.arange(len(prints))
        for i in range(self.segments):
            bits = self.parts[(i + 1) % self.segments][2]
            second = self.value(prints, i + 1)
            base = ((np.uint64(i) << np.uint64(56)) | (self.value(prints, i) << np.uint64(bits))).astype(np.uint64)
            keys.append(base | second)
            flipped.append(np.zeros(len(prints), bool))
            rows.append(every)
            for b in range(bits):
                zero = np.flatnonzero((second >> np.uint64(b)) & np.uint64(1) == 0)
                keys.append(base[zero] | second[zero] | np.uint64(1 << b))
                flipped.append(np.ones(len(zero), bool))
                rows.append(zero)
        return np.concatenate(keys).astype(np.int64), np.concatenate(flipped), np.concatenate(rows)

    def deeper(self, keys: np.ndarray, flipped: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of crowded keys under keys that have the third segment, too: key, whether a bit was set, row.

        Pairs that agree in the first two segments may differ in two bits of the third, and meet where each stands
        with none or one of its bits turned; pairs that differ in one bit already may differ in one more, which the
        side with the bit set turns.
        """
        keys_, flips, rows = [], [], []
        start = (keys >> 56).astype(np.int64)
        for i in range(self.segments):
            own = np.flatnonzero(start == i)
            if not len(own):
                continue
            third, bits, turned = self.value(prints[own], i + 2), self.parts[(i + 2) % self.segments][2], flipped[own]
            for b in range(-1, bits):
                value = third ^ np.uint64(1 << b) if b >= 0 else third
                for kind, at in ((0, np.flatnonzero(~turned)), (1, np.flatnonzero(turned | (b < 0)))):
                    if len(at):
                        x = keys[own[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (value[at] << np.uint64(1)) + np.uint64(kind)
                        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                        keys_.append((np.uint64(i) << np.uint64(56)) | ((x ^ (x >> np.uint64(27))) >> np.uint64(8)))
                        flips.append(turned[at])
                        rows.append(own[at])
        return np.concatenate(keys_).astype(np.int64), np.concatenate(flips), np.concatenate(rows)

    def linked(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which pairs keep to the budgets of runs from the segment in the key, then to the radius."""
        apart = a ^ b
        start = (keys >> 56).astype(np.int64)
        alive = np.ones(len(a), bool)
        for i in range(self.segments):
            of = np.flatnonzero(start == i)
            spent = np.zeros(len(of), np.int64)
            for length in range(1, self.segments):
                spent += np.bitwise_count(self.value(apart[of], i + length - 1))
                ok = spent <= length * self.radius // self.segments
                alive[of[~ok]] = False
                of, spent = of[ok], spent[ok]
        return alive & (np.bitwise_count(apart).sum(1) <= self.radius)


def _reach(ring: Ring, start: int, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places in ``rows`` that keep to the chain of budgets from segment ``start`` and to the radius."""
    apart = rows ^ x
    alive = np.arange(len(rows))
    spent = np.zeros(len(rows), np.int64)
    for length in range(1, ring.segments):
        spent = spent + np.bitwise_count(ring.value(apart[alive], start + length - 1))
        ok = spent <= length * ring.radius // ring.segments
        if not ok.all():
            alive, spent = alive[ok], spent[ok]
            if not len(alive):
                return alive
    return alive[np.bitwise_count(apart[alive]).sum(1) <= ring.radius]


def _search(ring: Ring, start: int, prints: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a spanning forest, by chains from segment ``start``, and each print's tree: a print
    leaves the rest when it is first reached."""
    links, label, rest = [], np.zeros(len(prints), np.int64), np.arange(len(prints))
    while len(rest):
        queue, tree, rest = [int(rest[0])], int(rest[0]), rest[1:]
        label[tree] = tree
        while queue and len(rest):
            x = queue.pop()
            near = _reach(ring, start, prints[x], prints[rest])
            if not len(near):
                continue
            found = rest[near]
            label[found] = tree
            links += [(x, y) for y in found.tolist()]
            queue += found.tolist()
            rest = np.delete(rest, near)
        if queue:
            label[queue] = tree
    return links, label


def _cross(ring: Ring, start: int, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """A link for each tree of ``one`` and tree of ``two`` that any link joins. Links inside either are
    those of another key or block, which gives them."""
    met = [(x, y) for x in range(len(one)) for y in _reach(ring, start, one[x], two).tolist()]
    if len(met) < 2:
        return met
    pairs = np.array(met, np.int64)
    labels = []
    for side, prints in enumerate((one, two)):
        used, place = np.unique(pairs[:, side], return_inverse=True)
        labels.append(_search(ring, start, prints[used])[1][place])
    _, first = np.unique(np.stack(labels, 1), axis=0, return_index=True)
    return pairs[first].tolist()


def _linker(ring: Ring, hot: int | None):
    """Streams rows (key, flipped, side, fingerprint) in key order; gives stars of links, and rows of
    keys with more than ``hot`` rows as they are (``b`` null)."""
    each = ring.width // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept, passing = Forest(), None, None

        def out(a: list, b: list, key: int | None = None, flips: np.ndarray | None = None) -> pa.RecordBatch:
            keys = pa.array([key] * len(a), pa.int64())
            flipped = pa.array([None] * len(a) if flips is None else flips, pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), keys, flipped], ["a", "b", "key", "flipped"])

        def passed(prints: np.ndarray, flips: np.ndarray, key: int) -> pa.RecordBatch:
            return out(_bytes(prints), [None] * len(prints), key, flips)

        def link(one: np.ndarray, two: np.ndarray) -> None:
            for x, y in zip(_bytes(one), _bytes(two), strict=True):
                forest.join(x, y)

        def large(key: int, flips: np.ndarray, sides: np.ndarray, prints: np.ndarray) -> None:
            start = key >> 56
            base = [prints[~flips & (sides == k)] for k in (0, 1)]
            turned = [prints[flips & (sides == k)] for k in (0, 1)]
            if not len(base[1]) and not len(turned[1]):
                joined = [(base[0], base[0], _search(ring, start, base[0])[0]), (base[0], turned[0], _cross(ring, start, base[0], turned[0]))]
            else:  # two blocks of one key: what is inside a block is another task's
                joined = [(x, y, _cross(ring, start, x, y)) for x, y in ((base[0], base[1]), (base[0], turned[1]), (base[1], turned[0]))]
            for x, y, pairs in joined:
                at = np.array(pairs, np.int64).reshape(-1, 2)
                link(x[at[:, 0]], y[at[:, 1]])

        def whole(keys: np.ndarray, flips: np.ndarray, sides: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            useful = (sizes > 1) & ~flips[starts]  # rows with no bit set come first; without one, no pair shares the key so
            small = np.repeat(useful & (sizes <= SMALL), sizes)
            at = np.flatnonzero(small)
            k, f, p = keys[at], flips[at], prints[at]
            for d in range(1, SMALL):
                same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else ()
                if not len(same):
                    break
                same = same[~(f[same] & f[same + d])]
                same = same[ring.linked(p[same], p[same + d], k[same])]
                link(p[same], p[same + d])
            for g in np.flatnonzero(useful & (sizes > SMALL)):
                own = slice(starts[g], starts[g] + sizes[g])
                if hot and sizes[g] > hot:
                    yield passed(prints[own], flips[own], int(keys[starts[g]]))
                else:
                    large(int(keys[starts[g]]), flips[own], sides[own], prints[own])

        for batch in batches:
            key, flips, sides = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u8").astype(np.uint64).reshape(-1, each // 8)
            new = (key, flips, sides, prints)
            if passing is not None:
                n = int(np.searchsorted(new[0], passing, side="right"))
                if n:
                    yield passed(new[3][:n], new[1][:n], passing)
                new = tuple(x[n:] for x in new)
                if len(new[0]):
                    passing = None
            kept = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
            if not len(kept[0]):
                continue
            last = int(np.searchsorted(kept[0], kept[0][-1], side="left"))
            yield from whole(*(x[:last] for x in kept)) if last else ()
            kept = tuple(x[last:] for x in kept)
            if hot and len(kept[0]) > hot:
                passing = int(kept[0][0])
                yield passed(kept[3], kept[1], passing)
                kept = None
            if len(forest.parent) > FLUSH:
                yield out(*map(list, zip(*forest.stars(), strict=True)))
                forest = Forest()
        if kept is not None and len(kept[0]):
            yield from whole(*kept)
        if stars := forest.stars():
            yield out(*map(list, zip(*stars, strict=True)))

    return run


def _bytes(prints: np.ndarray) -> list[bytes]:
    raw, each = prints.astype(">u8").tobytes(), prints.shape[1] * 8
    return [raw[i : i + each] for i in range(0, len(raw), each)]


LINKS = "a binary, b binary, key bigint, flipped boolean"
KEYED = "key bigint, flipped boolean, side int, fingerprint binary"


def links(nodes: DataFrame, width: int = 64, radius: int = 4, hot: int = HOT) -> DataFrame:
    """``nodes(fingerprint)``, each once and none null; returns ``(a, b)`` of which the components are those of
    all pairs within ``radius``. No nodes, or none alike: no rows. Other columns are not looked at."""
    prepare(nodes.sparkSession)
    ring = Ring(width, radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                prints = _unhex(batch.column(0).slice(at, 2048), width)
                keys, flipped, rows = ring.keys(prints)
                raw = pa.array(_bytes(prints), pa.binary()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flipped), pa.array(np.zeros(len(keys), np.int32)), raw], ["key", "flipped", "side", "fingerprint"])

    def deepen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = part.column(2)
                prints = np.frombuffer(b"".join(raw.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width // 64)
                keys, flipped, rows = ring.deeper(part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), prints)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flipped), pa.array(np.zeros(len(keys), np.int32)), raw.take(pa.array(rows))], ["key", "flipped", "side", "fingerprint"])

    named = [F.lower(F.hex(c)).alias(c) for c in ("a", "b")]
    keyed, edges = nodes.select("fingerprint").mapInArrow(spread, KEYED), None
    for _ in range(2):
        met = keyed.repartition("key").sortWithinPartitions("key", "flipped")
        found = cut(met.mapInArrow(_linker(ring, hot), LINKS))
        more = found.where("b is not null").select(*named)
        edges = more if edges is None else edges.unionByName(more)
        passed = found.where("b is null").select("key", "flipped", F.col("a").alias("fingerprint"))
        if passed.isEmpty():
            return edges
        keyed = passed.mapInArrow(deepen, KEYED)
    blocks = passed.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = passed.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "flipped", (F.col("own") > F.col("other")).cast("int").alias("side"), "fingerprint")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "flipped")
    more = dealt.mapInArrow(_paired(_linker(ring, None)), LINKS)
    return edges.unionByName(more.select(*named))


def _paired(linker):
    """``linker`` over rows (key, low, high, flipped, side, fingerprint), each (key, low, high) by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield from linker(iter([pa.Table.from_batches(held).combine_chunks().to_batches()[0]]))

        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[at]:
                    if names[at] != own:
                        yield from close()
                        held, own = [], names[at]
                    held.append(batch.slice(at, k - at).select(["key", "flipped", "side", "fingerprint"]))
                    at = k
        yield from close()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, width: int = 64, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fingerprint``, ``component_id``.

    component_id: the smallest id reachable over links of at most ``radius`` differing bits, the
    row's own included. Null and blank texts have a fingerprint of zeros and link like any other.
    Rows with a null id stay, count as no id for the minimum, and get a null component only where
    no row of the component has an id. Repeated rows stay repeated. Other columns are not looked
    at, whatever their names. No rows: no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, size, width))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("first")))
    roots = connected_components(links(nodes, width, radius))
    joined = cut(nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"))
    least = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = joined.join(least, "root", "left").select("fingerprint", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(named, "fingerprint").select("id", "fingerprint", "component_id")


def counted_fingerprint(text: str | None, width: int = 128, seed: int = 42) -> str:
    """Like ``text_fingerprint`` of words, but the k-th time a word stands is a feature of its own: a new
    word in a long text of few distinct words moves it by its share of all words."""
    counts = Counter((text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split())
    if not counts:
        return "0" * (width // 4)
    raw = b"".join([xxhash.xxh3_128_digest(w, seed) for w in counts])
    hashes = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)[:, : width // 64]
    times = np.fromiter(counts.values(), np.int64, len(counts))
    total, upto = int(times.sum()), np.cumsum(times)
    ones = np.zeros(width, np.int64)
    for at in range(0, total, CHUNK):
        place = np.arange(at, min(at + CHUNK, total))
        word = np.searchsorted(upto, place, side="right")
        turn = (place - (upto - times)[word]).astype(np.uint64)
        x = hashes[word] + turn[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype(">u8").view(np.uint8), axis=1)
        for part in range(0, len(bits), 255):
            ones += bits[part : part + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > total).tobytes().hex()


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of ``size`` words, in order; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    shingles = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles)))


def _alike(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the pairs of sets whose similarity (shared of all members) is ``least`` or more."""
    sizes = np.array([len(x) for x in sets], np.int64)
    members, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    inside, rest = np.zeros(len(members), bool), np.arange(len(sets))
    left, of = flat, owner  # members of the sets in ``rest``, thinned out when half of them have gone
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            own = flat[begins[x] : begins[x] + sizes[x]]
            inside[own] = True
            shared = np.bincount(of[inside[left]], minlength=len(sets))[rest]
            inside[own] = False
            every = sizes[rest] + sizes[x] - shared
            near = (shared / np.maximum(every, 1) >= least) | (every == 0)
            for y in rest[near].tolist():
                yield x, y
                queue.append(y)
            rest = rest[~near]
            if near.any() and int(sizes[rest].sum()) * 2 < len(left):
                stays = np.zeros(len(sets), bool)
                stays[rest] = True
                left, of = left[stays[of]], of[stays[of]]


def _confirmer(least: float):
    """Streams rows (key, digest, hub, shingles) in key order; gives stars of the links of each key, and (text, null)
    of texts in the tree of the largest tree of the key's hub, which is the same for all keys of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, held, hub, main = Forest(), None, {}, [], []

        def close() -> None:
            names, sets = list(held), list(held.values())
            for x, y in _alike(sets, least) if len(held) > 1 else ():
                forest.join(names[x], names[y])
            if hub:
                own = Forest()
                for x, y in _alike([held[n] for n in hub], least):
                    own.join(hub[x], hub[y])
                sizes = Counter(map(own.find, hub))
                tree = forest.find(min(sizes, key=lambda x: (-sizes[x], x)))
                main.extend(n for n in names if forest.find(n) == tree)

        for batch in batches:
            for k, digest, own, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    close()
                    key, held, hub = k, {}, []
                held[digest] = np.frombuffer(raw, np.uint64)
                if own:
                    hub.append(digest)
        close()
        stars = forest.stars() + [(n, None) for n in main]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in stars], pa.string()), pa.array([b for _, b in stars], pa.string())], ["a", "b"])

    return run


def confirmed(texts: DataFrame, groups: DataFrame, least: float = ALIKE, size: int = SHINGLE, held: int = HELD) -> DataFrame:
    """``texts(id, digest, text)``, ``groups(id, node, root)`` with each digest once, as node, and one of its
    ids, which tells its copies apart; returns ``(a, b)`` of which the components are those of all pairs of one group that are ``least`` alike or more in their
    ``size``-word shingles.

    Groups of more than ``held`` texts are dealt out in blocks. First each block meets block 0. Texts that are
    then in the tree of block 0's largest tree are joined already; only the others meet all blocks, so that rows
    grow with the texts of a group times the blocks of those others.

    Null and blank texts have no shingles, and are alike among themselves; copies of a text are one row; groups of one text give no pair. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = pa.array([shingle_set(t, size).tobytes() for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["root", "digest", "shingles"])

    blocks = groups.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    blocks = cut(blocks.select("root", F.ceil(F.col("n") / held).cast("int").alias("blocks")))
    groups = groups.join(blocks.select("root"), "root", "left_semi").withColumnRenamed("id", "of")
    met = texts.join(groups, texts["id"].eqNullSafe(groups["of"]) & (texts["digest"] == groups["node"]))
    met = met.groupBy("root", "digest").agg(F.first("text").alias("text"))
    sets = cut(met.mapInArrow(run, "root string, digest string, shingles binary"))
    hash_ = F.xxhash64("digest")
    own = F.pmod(hash_, F.col("blocks")).cast("int")
    ends = F.expr("if(own = 0, sequence(least(1, blocks - 1), blocks - 1), array(own))")  # block 0 is in every task
    dealt = sets.join(blocks, "root").withColumn("own", own).withColumn("end", F.explode(ends)).withColumn("hub", F.expr("own = 0 and blocks > 2"))
    found = cut(_compared(dealt.select(F.concat_ws("/", "root", "end").alias("key"), "digest", "hub", "shingles"), least))
    first = found.where("b is not null")
    wide = blocks.where("blocks > 2")
    if wide.isEmpty():
        return first
    main = found.where("b is null").select(F.col("a").alias("digest")).distinct().withColumn("main", F.lit(True))
    rows = cut(sets.select("root", "digest").join(wide.select("root"), "root").join(main, "digest", "left"))
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.count_if(F.col("main").isNull()).alias("loose")).where("loose > 0")
    several = cut(sizes.select("root", *(F.ceil(F.col(n) / held).cast("int").alias(name) for n, name in (("n", "blocks"), ("loose", "rests")))))
    if several.isEmpty():
        return first
    rows = sets.join(rows, ["root", "digest"]).join(several, "root").withColumn("hub", F.lit(False))
    rest = F.pmod(hash_, F.col("rests")).cast("int")
    every = rows.withColumn("block", own).withColumn("rest", F.explode(F.expr("sequence(0, rests - 1)")))
    loose = rows.where("main is null").withColumn("rest", rest).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = every.unionByName(loose).select(F.concat_ws("/", "root", "rest", "block").alias("key"), "digest", "hub", "shingles")
    return first.unionByName(_compared(dealt, least).where("b is not null"))


def _compared(dealt: DataFrame, least: float) -> DataFrame:
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_confirmer(least), "a string, b string")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1, width: int = 128, radius: int = 15, least: float = ALIKE, held: int = HELD) -> DataFrame:
    """``docs`` with one row of each component, columns as they were: the smallest id (a null id
    only where there is no other), then the smallest SHA-256 of the text; of rows that agree in
    both, any one.

    Null and blank texts are alike, so that one of them stays; repeated rows are copies. Extra columns are
    passed on, whatever their names. No rows: no rows.

    Links are pairs that are ``least`` alike or more in their five-word shingles. Candidates are all pairs
    that chains of fingerprints within ``radius`` join, those of ``size``-word shingles and those of
    words counted; each is held to the shingles themselves.
    """
    text = F.col(text_col).cast("string")
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    both = fingerprints(docs, id_col, text_col, size, width, [digest.alias("digest")], counted=True)
    prints = cut(both)
    none = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    nodes = cut(prints.groupBy("digest").agg(F.min("fingerprint").alias("plain"), F.min("counted").alias("counted"), F.min(none).alias("first")))
    # a text joins its group by the one fingerprint and its group by the other
    joined = cut(nodes.select("digest", F.col("first.id").alias("id"), *(F.concat(F.lit(f"{kind} "), kind).alias(end) for kind, end in (("plain", "a"), ("counted", "b")))))
    edges = joined.select("a", "b")
    for kind in ("plain", "counted"):
        met = links(nodes.select(F.col(kind).alias("fingerprint")).distinct(), width, radius)
        edges = edges.unionByName(met.select(*(F.concat(F.lit(f"{kind} "), end).alias(end) for end in ("a", "b"))))
    roots = connected_components(edges).withColumnRenamed("node", "a")
    groups = cut(joined.join(roots, "a").select("id", F.col("digest").alias("node"), "root"))
    exact = confirmed(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), text.alias("text")), groups, least, held=held)
    roots = connected_components(exact).withColumnRenamed("node", "digest")
    group = F.coalesce("root", "digest")
    first = nodes.join(roots, "digest", "left").groupBy(group.alias("group")).agg(F.min("first").alias("first"))
    stay = cut(first.select(F.col("first.id").alias("of"), F.col("first.digest").alias("kept")))
    twice = cut(prints.groupBy(F.col("id").alias("of"), F.col("digest").alias("kept")).count().where("count > 1").drop("count"))
    same = lambda a, b: a["id"].eqNullSafe(b["of"]) & (a["digest"] == b["kept"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    if twice.isEmpty():
        return rows.join(stay, same(rows, stay), "left_semi").select("row.*")
    single = stay.join(twice, stay["of"].eqNullSafe(twice["of"]) & (stay["kept"] == twice["kept"]), "left_anti")
    several = stay.join(twice, stay["of"].eqNullSafe(twice["of"]) & (stay["kept"] == twice["kept"]), "left_semi")
    once = rows.join(several, same(rows, several), "left_semi").dropDuplicates(["id", "digest"])
    return rows.join(single, same(rows, single), "left_semi").unionByName(once).select("row.*")
