"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are given out.

A word begins as one symbol for each of its bytes. Adjacent pairs wait in a heap by the rank of
their merge; the lowest is taken out, its two symbols become one in the linked list, and the pairs
at its sides are put in. The count is the number of first symbols less the number of merges.

The vocabulary is a tokenizer file for the ``tokenizers`` library with a byte-level BPE model. It is
read on the driver and broadcast (its size is that of the file, and checked). The library splits
texts into words by the file's own rules; for the common case of a lower-casing Latin text a plain
pattern does the same. Counts of words are kept by the worker up to ``KEPT`` words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import prepare

LIMIT = 2048
KEPT = 1_000_000
LONGEST_KEPT = 64
LARGEST_FILE = 64 << 20
# The split pattern of the word vocabulary, and its normalizers.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Characters for which Python's classes and the library's agree, that composition leaves alone, and
# that are lower-cased one by one.
PLAIN = re.compile("[\\t\\n\\x0b\\f\\r -~¡-ɏ]*")
PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼-¾]+|[\\d²³¹¼-¾]|(?:[^\\w\\s]|_)+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes for those from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Words(dict):
    """Counts of words, each found when first asked for."""

    def __init__(self, count) -> None:
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts tokens by the rules of one tokenizer file."""

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        said = json.loads(text)
        model = said["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE vocabularies are counted")
        self.library = Tokenizer.from_str(text)
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b] if a + b in vocab else vocab[a.removesuffix(suffix) + b]))
        added = [x for x in said.get("added_tokens", [])]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens that take in their surroundings are not counted")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        normal = said.get("normalizer") or {}
        parts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = [x["type"] for x in normal.get("normalizers", [])] == WORD_NORMALIZERS and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        self.words = Words(self.word)

    def word(self, raw: bytes) -> int:
        """Symbols that are left of one word."""
        n = len(raw)
        if n < 2:
            return n
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merge = self.merge
        heap = [(m[0], i, m[1], a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := merge.get((a, b)))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged since
            merges += 1
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return n - merges

    def piece(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if self.plain and PLAIN.fullmatch(text):
            return sum(map(self.words.__getitem__, PLAIN_WORD.findall(text.lower())))
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return sum(self.word(bytes(map(self.byte.__getitem__, w))) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.piece(text)
        found = self.special.findall(text)
        return len(found) + sum(self.piece(p) for p in self.special.split(text) if p)


_counters: dict[str, Counter] = {}


def counter(text: str) -> Counter:
    """The counter of a file's text, one for each worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(text)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary``: path of the tokenizer file. Null texts count as empty, with no tokens; added
    tokens in a text count one each. Ids are passed on as they are, repeated rows and nulls
    included; other columns are not looked at. No rows: no rows. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    file = Path(vocabulary)
    if file.stat().st_size > LARGEST_FILE:
        raise ValueError("the vocabulary is too large to broadcast")
    said = docs.sparkSession.sparkContext.broadcast(file.read_text("utf-8"))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(said.value)
        for batch in batches:
            n = [count.text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
