"""Substrings of texts by an index of character trigrams.

Every text's distinct trigrams are kept as a row for each trigram and some thousand texts, in folders by a hash of the trigram, made and sorted where the texts are and not shuffled,
with a count for each trigram; they are read as a row for each trigram and text. A substring's trigrams all stand in a text that holds it: the rarest few are intersected, the rarest first,
and what is left is looked into. Texts lie in folders by a hash of their slug, and the lists name them by the same hash; only folders of candidates are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from .tables import Sharded

SIZE = 3
SHARDS = 16  # folders of trigrams, with a file of every task
LETTERS_A_TASK = 64_000_000  # of texts whose trigrams one task takes out and sorts, where there are more tasks than cores
LETTERS = 4_000_000  # whose trigrams are sorted together, or one text
ENTRIES = 500_000  # in a batch that a task gives
RAREST = 4  # trigrams that are intersected
TEXTS_A_FOLDER = 2_000


def gram_lists(docs: np.ndarray, texts: list[str], letters: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The distinct trigrams of ``texts``, in the order of their letters, and ``docs`` of the texts that have them: the list of grams[i] is entries[ends[i] : ends[i + 1]]."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    if len(points) < SIZE:
        return
    alphabet = np.flatnonzero(np.bincount(points))
    size, n = len(alphabet), len(texts)
    if n > 1 and size**SIZE * n >= 2**62:  # texts of so many different letters, a half at a time
        for half in (slice(0, n // 2), slice(n // 2, n)):
            yield from gram_lists(docs[half], texts[half], letters)
        return
    rank = np.zeros(alphabet[-1] + 1, "int64")
    rank[alphabet] = np.arange(size)
    of, found = np.repeat(np.arange(n), [len(t) for t in texts]), []
    for k in range(0, len(points) - SIZE + 1, letters):
        x, d = rank[points[k : k + letters + SIZE - 1]], of[k : k + letters + SIZE - 1]
        inside = d[: 1 - SIZE] == d[SIZE - 1 :]
        found.append(_distinct((((x[:-2] * size + x[1:-1]) * size + x[2:]) * n + d[:-2])[inside]))
    gram, at = np.divmod(found[0] if len(found) == 1 else _distinct(np.concatenate(found)), n)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    gram = gram[first]
    said = alphabet[np.stack([gram // size // size, gram // size % size, gram % size], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    yield [said[i : i + SIZE] for i in range(0, len(said), SIZE)], np.append(first, len(at)), docs[at]


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, sorted, each once."""
    codes = np.sort(codes)
    return codes[np.diff(codes, prepend=-1) > 0]


def _lister(letters: int, entries: int):
    """``(doc, text)`` as rows (gram, n, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ends, done = np.cumsum(pc.utf8_length(rows["text"]).to_numpy(zero_copy_only=False), dtype="int64"), 0
            while done < rows.num_rows:
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + letters, "right")))
                for grams, at, docs in gram_lists(rows["doc"][done:upto].to_numpy(), rows["text"][done:upto].to_pylist(), letters):
                    k = 0
                    while k < len(grams):
                        to = max(k + 1, int(np.searchsorted(at, at[k] + entries, "right")) - 1)
                        lists = pa.ListArray.from_arrays(pa.array(at[k : to + 1] - at[k], "int32"), pa.array(docs[at[k] : at[to]], "int64"))
                        yield pa.record_batch([pa.array(grams[k:to], "string"), pa.array(np.diff(at[k : to + 1]), "int64"), lists], ["gram", "n", "docs"])
                        k = to
                done = upto

    return run


class Trigrams(Sharded):
    FORMAT = 2

    @classmethod
    def build(cls, docs: DataFrame, root: str, key: str, folder: int = TEXTS_A_FOLDER) -> Trigrams:
        """An index of ``docs(slug, text)``, texts taken in lower case. Null texts hold nothing."""
        spark = docs.sparkSession
        index = cls(spark, root, {"key": key})
        texts = docs.select("slug", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        folders = max(1, docs.count() // folder)
        shards = min(SHARDS, 4 * folders)
        index.put_whole("texts", texts, "slug", folders, "slug")
        kept = index.table("texts")
        letters = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        kept = kept.select(F.xxhash64("slug").alias("doc"), "text").coalesce(max(spark.sparkContext.defaultParallelism, 1 + letters // LETTERS_A_TASK))
        importable(spark)
        index.put_where_made("grams", kept.mapInArrow(_lister(LETTERS, ENTRIES), "gram string, n bigint, docs array<bigint>"), "gram", shards, "gram")
        index.put("counts", index.lists().groupBy("gram").agg(F.sum("n").alias("n")), "gram", shards, "gram")
        index.finish()
        return index

    def lists(self) -> DataFrame:
        """(gram, n, docs, shard) as they are kept: n texts that have a trigram, by the hash of their slug."""
        return super()._read("grams", [f"{self.root}/grams"])

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        rows = super()._read(name, paths)
        return rows.select("gram", F.explode("docs").alias("doc"), "shard") if name == "grams" else rows

    def candidates(self, wanted: str) -> DataFrame:
        """(doc), hashes of slugs, of texts that hold the rarest trigrams of a substring of three characters or more."""
        grams = sorted({wanted[i : i + SIZE] for i in range(len(wanted) - SIZE + 1)})
        counts = {r["gram"]: r["n"] for r in self.of_keys("counts", grams).where(F.col("gram").isin(grams)).collect()}
        if len(counts) < len(grams):
            return self.spark.createDataFrame([], "doc bigint")
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        having = lambda g: self.of_keys("grams", [g]).where(F.col("gram") == g).select("doc")
        rows = having(rarest[0])
        for gram in rarest[1:]:
            rows = rows.join(having(gram), "doc", "left_semi")
        return rows

    def holding(self, wanted: str) -> DataFrame:
        """(slug, n, first) of all texts that hold ``wanted`` in any case: how often, overlaps not counted, and where first, from 1.

        Shorter substrings than trigrams are looked for in all texts; the empty one is nowhere.
        """
        wanted = wanted.lower()
        rows = self.table("texts").where(F.lit(len(wanted) > 0))
        if len(wanted) >= SIZE:
            found = self.candidates(wanted)
            folders = self.state["tables"]["texts"][1]
            shards = [r[0] for r in found.select(F.pmod("doc", F.lit(folders)).cast("int")).distinct().collect()]  # a number a folder
            rows = self.of_shards("texts", sorted(shards)).join(found, F.xxhash64("slug") == F.col("doc"), "left_semi")
        held = rows.where(F.col("text").contains(wanted))
        n = (F.length("text") - F.length(F.replace("text", F.lit(wanted), F.lit("")))) / max(1, len(wanted))
        return held.select("slug", n.cast("long").alias("n"), F.instr("text", wanted).cast("long").alias("first"))
