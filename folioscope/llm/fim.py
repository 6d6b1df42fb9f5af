"""Fill-in-the-middle: texts are cut at two token boundaries and put together again around sentinels.

A token is a run of characters other than blanks (``[\\x20\\x09-\\x0D]``) with the blanks before it; blanks at the
end of the text are one more. One Aho-Corasick automaton goes over a text once and tells of the few characters at
which something can change: the six blanks, and the three sentinels. Between two blanks that aren't neighbours lies
the end of one token, so the gaps between events alone give the number of tokens and where each ends; a cut after
m tokens is looked up by its rank among these ends, and no token is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import prepare

# The blanks, and the sentinels with which psm and spm begin each part.
BLANKS = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE, SPM_SHARE = 50, 80
RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"


def automaton():
    """Blanks are worth 0, sentinels 1."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for blank in BLANKS:
        found.add_word(blank, 0)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, 1)
    found.make_automaton()
    return found


def token_ends(text: str, events) -> tuple[np.ndarray, bool]:
    """Where each token ends, in code points, in order, and whether the text holds a sentinel."""
    flat = np.fromiter((at if kind == 0 else -1 for at, kind in events.iter(text)), np.int64)
    blanks = flat[flat >= 0]
    edges = np.concatenate(([-1], blanks, [len(text)]))
    ends = edges[1:][np.diff(edges) > 1]  # a gap wider than one step holds a word, which ends where the gap does
    if len(blanks) and blanks[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(blanks) < len(flat)


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of seed and id; a null id is written as nothing."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(said[i : i + 8], 16) for i in (0, 8, 16, 24))


def restored(output: str, form: str) -> str:
    """The text that was put into ``form``: the parts of an output stand between its first sentinels."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(MIDDLE)
    return a + middle + b if form == "psm" else b + middle + a


def rewritten(text: str, doc_id, events, rate: int = RATE, spm: int = SPM_SHARE, seed: int = SEED) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends, reserved = token_ends(text, events)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or reserved or h3 % 100 >= rate:
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[m - 1]) if m else 0 for m in (one, two))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain), output (the training text) and restored (the text rebuilt from output and form alone).

    ``rate`` per cent of the texts are cut, ``spm`` per cent of these begin with the suffix. Null texts count as empty, which stay
    plain with no tokens, like texts that hold a sentinel; texts of blanks are one token; texts are cut whole, to any length.
    Rows of one id are cut alike, and repeated rows come out repeated; a null id counts as an empty one. Other columns
    aren't looked at. No rows: no rows. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = automaton()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # outputs of few texts at a time
                part = batch.slice(k, 256)
                made = [rewritten(t.as_py(), i.as_py(), events, rate, spm, seed) for i, t in zip(part.column(0), part.column(1), strict=True)]
                n, form, a, b, output = (list(x) for x in zip(*made, strict=True))
                back = [restored(x, f) for x, f in zip(output, form, strict=True)]
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(output, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return rows.mapInArrow(run, f"id {kind}, {RESULT}")
