"""WARC records, and a fixity audit of replicas by Merkle trees.

Records of an archive file stand in order of offset. A leaf of a file's tree is the SHA-256 of a record's
offset, length and own SHA-256; a node stands for a range of ``FAN`` consecutive children and is the SHA-256
of their numbers, the ranges of bytes that they span, and their hashes. Two replicas are compared by their roots; for files whose
roots differ, the children of differing nodes are compared, level by level, down to the records. What is read
at each level is only what lies below a difference, and only damaged places are told of.

The levels are tables in the checkpoint folder, each a ``FAN``-th of the one below; no step gathers more than
``FAN`` hashes (and records that claim the same place). Records get their place in the file (``seq``,
``offset``) by sums over ranges of one global order, in which a file may span many ranges, so that no task
holds a whole file. Bodies are hashed where they are read and are not shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut, prepare

FAN = 16
PER_FILE = 4096
ACTIONS = ("intact", "corrupt", "moved", "missing", "extra")
CHUNK = 1 << 20  # bytes that are unzipped at a time
GATHER = 16 << 20  # bytes of records in a batch of ``read``


def record_bytes(url: Column, body: Column, at: Column) -> Column:
    """A WARC/1.1 resource record as text: header lines, an empty line, the body, two line ends.

    Null parts are empty ones. ``at``: the record's date, ISO 8601.
    """
    body = F.coalesce(body.cast("string"), F.lit(""))
    address = F.coalesce(url.cast("string"), F.lit(""))
    name = F.md5(F.concat(address, F.lit("\n"), body).cast("binary"))
    urn = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("resource")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), urn, F.lit(">"))),
        line("WARC-Target-URI", address), line("WARC-Date", at), line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, files: int, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, url, record, file, length, sha256): the pages as records, dealt to ``files`` archive files by the
    MD5 of id and address. Null parts are empty ones; repeated pages make repeated records."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.col(body_col).alias("body"))
    rows = rows.select("id", "url", record_bytes(F.col("url"), F.col("body"), F.lit(at)).alias("record"))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("")), "url").cast("binary"))
    rows = rows.withColumn("file", F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % files)
    return rows.withColumn("length", F.octet_length("record").cast("long")).withColumn("sha256", F.sha2("record", 256))


def laid(rows: DataFrame) -> DataFrame:
    """``rows`` of ``records``, with or without the records themselves, with ``seq`` and ``offset``.

    In a file records stand in order of id (nulls last), address and hash; equal ones stand one after
    another. Any file may hold most rows: they are ordered in ranges of all files' rows, and places are
    sums over the ranges and then within a range.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())  # equal rows can stand in any order, and in several ranges
    ranges = cut(rows.orderBy("file", F.col("id").isNull(), "id", "url", "sha256", tie))
    ranges = ranges.withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id()})
    sums = ranges.groupBy("file", "range").agg(F.count("*").alias("rows"), F.sum("length").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    base = sums.select("file", "range", zero(F.sum("rows").over(earlier)).alias("rows"), zero(F.sum("bytes").over(earlier)).alias("bytes"))
    inside = Window.partitionBy("file", "range").orderBy("nth")
    before = zero(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    placed = ranges.withColumns({"seq": F.row_number().over(inside).cast("long") - 1, "offset": before}).join(base, ["file", "range"])
    placed = placed.withColumns({"seq": F.col("seq") + F.col("rows"), "offset": F.col("offset") + F.col("bytes")})
    return placed.drop("range", "nth", "rows", "bytes")


def archive(pages: DataFrame, files: int, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(file, seq, offset, length, id, url, record, sha256): the pages as archive files, to be written.

    No pages: no rows. Other columns than the three are not looked at, whatever their names.
    """
    return laid(records(pages, files, id_col, url_col, body_col, at))


def files_for(n: int, per_file: int = PER_FILE) -> int:
    return max(1, -(-n // per_file))


def tree(places: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """``places(file, seq, offset, length, sha256)``; returns the levels, leaves first: (file, node, hash,
    start, stop), leaves with ``leaf``, the records that claim the place.

    All files have as many levels as the longest needs, and one node on the last. Places without a file
    or seq are left out. No places: one level without rows.
    """
    leaf = F.struct("offset", "length", "sha256")
    own = lambda x: F.concat_ws(":", *(F.coalesce(x[c].cast("string"), F.lit("")) for c in ("offset", "length", "sha256")))
    level = places.dropna(subset=["file", "seq"]).groupBy("file", F.col("seq").alias("node")).agg(F.array_sort(F.collect_list(leaf)).alias("leaf"))
    level = level.select("file", "node", F.sha2(F.concat_ws(",", F.transform("leaf", own)), 256).alias("hash"), F.array_min("leaf.offset").alias("start"), F.array_max(F.transform("leaf", lambda x: x["offset"] + x["length"])).alias("stop"), "leaf")
    levels = [cut(level)]
    last = levels[0].agg(F.max("node")).first()[0]
    said = lambda x: F.concat_ws(":", *(F.coalesce(x[c].cast("string"), F.lit("")) for c in ("node", "start", "stop", "hash")))
    while last:
        last //= fan
        child = F.array_sort(F.collect_list(F.struct("node", "start", "stop", "hash")))
        level = levels[-1].groupBy("file", F.floor(F.col("node") / fan).alias("up")).agg(child.alias("c"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        levels.append(cut(level.select("file", F.col("up").alias("node"), F.sha2(F.concat_ws(",", F.transform("c", said)), 256).alias("hash"), "start", "stop")))
    return levels


def verdicts(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """(file, root, replica_root, intact) of every file of either tree; a file that one of them lacks isn't intact. Of empty trees: no rows."""
    a, b = (t[-1].where("node = 0").select("file", F.col("hash").alias(n)) for t, n in ((one, "root"), (two, "replica_root")))
    return a.join(b, "file", "full").withColumn("intact", F.coalesce(F.col("root") == F.col("replica_root"), F.lit(False)))


def differing(one: list[DataFrame], two: list[DataFrame], fan: int = FAN) -> DataFrame:
    """Trees of two replicas; returns (file, seq, a, b): the leaves that are not the same in both, null on the side that has none there.
    Equal trees: no rows; against an empty tree every leaf differs."""
    suspects = None
    for level in range(max(len(one), len(two)) - 1, -1, -1):
        kept = ["file", "node", "hash", *(["leaf"] if not level else [])]
        sides = [t[level] if level < len(t) else t[0].limit(0) for t in (one, two)]
        if suspects is not None:
            up = F.floor(F.col("node") / fan).alias("up")
            sides = [x.select("*", up).join(suspects, ["file", "up"], "left_semi") for x in sides]
        a, b = (x.select(*kept).select("file", "node", F.struct(*kept[2:]).alias(n)) for x, n in zip(sides, "ab", strict=True))
        apart = cut(a.join(b, ["file", "node"], "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))))
        suspects = apart.select("file", F.col("node").alias("up"))
    return apart.select("file", F.col("node").alias("seq"), F.col("a.leaf").alias("a"), F.col("b.leaf").alias("b"))


def audit(one: DataFrame, two: DataFrame, fan: int = FAN) -> DataFrame:
    """``one`` and ``two``: (file, seq, offset, length, sha256) of two replicas; returns the damaged places
    with ``status`` and the offsets, lengths and hashes of both.

    status: corrupt (another hash), moved (the same hash at another offset), missing (in ``one`` only) or extra
    (in ``two`` only). Of records that claim one place the first is told of, by offset, length and hash, and a
    repeat is a difference unless the other has it, too. A null hash is an empty one. A null file or seq has no place
    and is left out. Empty replicas: all missing, all extra or nothing. Other columns are not looked at.
    """
    return damage(*trees(one, two, fan), fan)


def trees(one: DataFrame, two: DataFrame, fan: int = FAN) -> list[list[DataFrame]]:
    """The trees of two replicas as ``audit`` takes them, for ``damage`` and ``verdicts``; of an empty replica one level without rows."""
    return [tree(x.select("file", "seq", "offset", "length", F.coalesce("sha256", F.lit("")).alias("sha256")), fan) for x in (one, two)]


def damage(one: list[DataFrame], two: list[DataFrame], fan: int = FAN) -> DataFrame:
    """``audit`` of trees that are made, which left out rows without a place and put repeats of a place into one leaf."""
    found = differing(one, two, fan)
    hashes = [F.transform(c, lambda x: x["sha256"]) for c in ("a", "b")]
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(hashes[0] == hashes[1], "moved").otherwise("corrupt")
    names = ["offset", "length", "sha256"]
    sides = [F.get(c, F.lit(0))[n].alias(p + n) for c, p in (("a", ""), ("b", "replica_")) for n in names]
    return found.select("file", "seq", status.alias("status"), *sides)


def _unzipped(data: bytes) -> Iterator[bytes]:
    """Bytes of a plain file or of one in gzip members, some at a time."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), CHUNK):
            yield data[at : at + CHUNK]
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            fed = view[at : at + CHUNK]
            if not len(fed):
                raise ValueError("a gzip member is cut short")
            at += len(fed)
            while len(fed):
                yield member.decompress(fed, CHUNK)
                fed = member.unconsumed_tail
        at -= len(member.unused_data)
        while at < len(data) and not data[at]:  # padding
            at += 1


def parse(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, body) of each record of a plain WARC file or one in gzip members; offset and
    length are those of the unzipped file. One record and a chunk are unzipped at a time."""
    for at, headers, body, raw in _parsed(data):
        yield at, len(raw), headers, body


def _parsed(data: bytes) -> Iterator[tuple[int, dict, bytes, bytes]]:
    chunks, held, at = _unzipped(data), bytearray(), 0

    def more() -> bool:
        chunk = next(chunks, None)
        held.extend(chunk or b"")
        return chunk is not None

    while True:
        while len(held) < 2 and more():
            pass
        if not held:
            return
        if held.startswith(b"\r\n"):
            del held[:2]
            at += 2
            continue
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                break
        if not held.startswith(b"WARC/") or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = bytes(held[:end]).split(b"\r\n")[1:]
        headers = {k.strip().decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        stop = end + 4 + int(headers.get("content-length", "0"))
        while len(held) < stop + 4 and more():
            pass
        if len(held) < stop:
            raise ValueError(f"a record is cut short at byte {at}")
        raw = bytes(held[: stop + 4])
        yield at, headers, raw[end + 4 : stop], raw
        del held[: stop + 4]
        at += len(raw)


def read(spark, path: str) -> DataFrame:
    """(path, seq, offset, length, url, date, body, sha256) of every record of the files under ``path``.

    A file is read by one task, which holds the file as stored (Spark's limit is 2 GB) and some records.
    A file of no records: no rows; one that is cut short or holds something else fails the job.
    """
    prepare(spark)
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "seq", "offset", "length", "url", "date", "body", "sha256"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for k in range(batch.num_rows):
                found, size = [], 0
                for i, (a, h, body, raw) in enumerate(_parsed(batch.column(1)[k].as_py())):
                    found.append((batch.column(0)[k].as_py(), i, a, len(raw), h.get("warc-target-uri"), h.get("warc-date"), body, hashlib.sha256(raw).hexdigest()))
                    size += len(raw)
                    if size >= GATHER:
                        yield out(found)
                        found, size = [], 0
                if found:
                    yield out(found)

    return rows.mapInArrow(run, "path string, seq bigint, offset bigint, length bigint, url string, date string, body binary, sha256 string")
