"""Relevance that knows frequency: BM25 over blocks of documents that carry their greatest score.

Documents are dealt into blocks by a hash of their slug. For each word and block the index keeps a peak, the most that the word
adds to any of the block's documents (its weight aside); the sum of a query's peaks bounds every score in the block. A search
scores the most promising blocks first; its k-th score is the threshold, and of the other blocks only those whose bound
reaches it are scored at all (block-max pruning; Ding and Suel, SIGIR 2011; Mallia, Suel and Tonellotto, SIGIR 2024). Results are those of plain BM25.

The index is made where the documents of whole blocks are: a row holds a word's peak in a block and its documents there, so that
neither occurrences nor peaks are shuffled, and peaks are read without the documents.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..workers import importable
from .local import local_rows
from .tables import Sharded

K1, B = 1.2, 0.75
BLOCK = 64  # documents in a block, about
SHARDS, DOCUMENTS_A_SHARD = 16, 2_000  # folders of each table, with a file of every task
WORDS_A_TASK = 3_000_000
POSTINGS = "block int, token string, peak double, documents long, entries array<struct<slug:string,length:long,tf:long>>"
FIRST = 32  # blocks that set the threshold


def gain(tf: Column, length: Column, mean: float) -> Column:
    """What a word of ``tf`` occurrences adds to a document of ``length`` words, before the word's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def weight(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def block_postings(rows: pa.Table, mean: float) -> pa.Table:
    """A row for each word of one block's ``rows(slug, block, words)``: its peak, and the documents that have it, with their lengths and how often."""
    lists = pa.concat_arrays(rows["words"].chunks)
    sizes, documents = pc.list_value_length(lists).to_numpy(), {}
    at = np.array([documents.setdefault(x, len(documents)) for x in zip(rows["slug"].to_pylist(), sizes.tolist(), strict=True)], dtype="int64")
    said = pc.dictionary_encode(lists.flatten())
    pairs, tf = np.unique(said.indices.to_numpy().astype("int64") * len(documents) + np.repeat(at, sizes), return_counts=True)
    word, at = np.divmod(pairs, len(documents))
    slugs, lengths = pa.array([s for s, _ in documents], "string"), np.array([n for _, n in documents], dtype="int64")[at]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    peaks = np.maximum.reduceat(gain(tf, lengths, mean), first) if len(first) else np.array([])
    ends = np.append(first, len(word))
    entries = pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.StructArray.from_arrays([slugs.take(pa.array(at)), pa.array(lengths), pa.array(tf, "int64")], ["slug", "length", "tf"]))
    return pa.table({"block": pa.repeat(rows["block"][0], len(first)), "token": said.dictionary.take(pa.array(word[first])), "peak": pa.array(peaks, "double"), "documents": pa.array(np.diff(ends), "int64"), "entries": entries})


class Bm25(Sharded):
    FORMAT = 2

    @classmethod
    def build(cls, docs: DataFrame, root: str, key: str, block: int = BLOCK) -> Bm25:
        """An index of ``docs(slug, text)``. Null texts have no words; slugs name one document each."""
        length = F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long")
        n, total = docs.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
        mean, blocks = max(total / n, 1e-9) if n else 1.0, max(1, -(-n // block))
        index = cls(docs.sparkSession, root, {"key": key, "n": n, "mean": mean, "blocks": blocks})
        dealt = docs.select("slug", "text", F.pmod(F.xxhash64("slug"), F.lit(blocks)).cast("int").alias("block")).repartition(min(blocks, 1 + total // WORDS_A_TASK), "block")
        words = dealt.select("slug", "block", T.tokens(F.coalesce("text", F.lit(""))).alias("words"))
        importable(docs.sparkSession)
        of_block = words.groupBy("block").applyInArrow(lambda rows: block_postings(rows, mean), POSTINGS)
        shards = max(1, min(SHARDS, n // DOCUMENTS_A_SHARD))
        index.put_where_made("postings", of_block, "token", shards, "token", "block")
        index.put("words", index.table("postings").groupBy("token").agg(F.sum("documents").alias("df")), "token", shards, "token")
        index.finish()
        return index

    def words_of(self, query: str) -> list[str]:
        """The query's distinct words, as the texts' are taken."""
        row = local_rows(self.spark, [(query,)], "q string").select(F.array_sort(F.array_distinct(T.tokens(F.col("q"))))).first()
        return list(row[0])

    def weights(self, words: list[str]) -> dict[str, float]:
        found = self.of_keys("words", words).where(F.col("token").isin(words)).collect() if words else []
        return {r["token"]: weight(self.state["n"], r["df"]) for r in sorted(found)}

    def bounds(self, weights: dict[str, float]) -> DataFrame:
        """(block, bound): the most that any document of a block can score."""
        peaks = self.of_keys("postings", list(weights)).where(F.col("token").isin(list(weights)))
        return peaks.groupBy("block").agg(F.sum(_weighed(weights) * F.col("peak")).alias("bound"))

    def scored(self, weights: dict[str, float], blocks: DataFrame) -> DataFrame:
        """(slug, score) of the documents of some blocks that have a word; added up in the words' order, so that reruns agree."""
        rows = self.of_keys("postings", list(weights)).where(F.col("token").isin(list(weights))).join(blocks.select("block"), "block", "left_semi").select("token", F.inline("entries"))
        part = gain(F.col("tf"), F.col("length"), self.state["mean"])
        by = rows.groupBy("slug").agg(*(F.max(F.when(F.col("token") == w, part * F.lit(x))).alias(f"w{i}") for i, (w, x) in enumerate(weights.items())))
        return by.select("slug", reduce(lambda a, b: a + b, (F.coalesce(f"w{i}", F.lit(0.0)) for i in range(len(weights)))).alias("score"))

    def threshold(self, weights: dict[str, float], k: int, first: int = FIRST) -> tuple[float, list[int]]:
        """The k-th score of the ``first`` blocks, or -1 if they have fewer documents with a word; and these blocks."""
        best = [r["block"] for r in self.bounds(weights).orderBy(F.desc("bound"), "block").limit(first).collect()]
        tops = self.scored(weights, self.bounds(weights).where(F.col("block").isin(best))).orderBy(F.desc("score")).limit(k).collect()
        return (tops[-1]["score"] if len(tops) == k else -1.0), best

    def needed(self, weights: dict[str, float], least: float) -> DataFrame:
        """Blocks whose bound reaches ``least``, to the last digits of a sum."""
        return self.bounds(weights).where(F.col("bound") * (1 + 1e-9) >= least)

    def top(self, query: str, k: int = 20) -> DataFrame:
        """(rank, slug, score) of the best ``k``, ties by slug. A query without words that the documents have finds nothing."""
        weights = self.weights(self.words_of(query))
        if not weights:
            return self.spark.createDataFrame([], "rank int, slug string, score double")
        least, _ = self.threshold(weights, k)
        best = self.scored(weights, self.needed(weights, least)).orderBy(F.desc("score"), "slug").limit(k).collect()
        return local_rows(self.spark, [(i, r["slug"], r["score"]) for i, r in enumerate(best, 1)], "rank int, slug string, score double")


def _weighed(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a.when(F.col("token") == b[0], F.lit(b[1])), list(weights.items())[1:], F.when(F.col("token") == next(iter(weights)), F.lit(next(iter(weights.values())))))
