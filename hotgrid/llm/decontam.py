"""Benchmark decontamination (operator 6): one Aho-Corasick automaton over normalised items.

Texts are scanned once, as bytes: a byte table lower-cases A-Z and turns every byte that
ends a word into a space, so that a byte of the normalised text stands where it stood in
the original and a hit's offsets need no search to be mapped back.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text that one automaton may be built of; a larger benchmark has several.
BLOCK_BYTES = 8_000_000
#: Bytes of documents that a task holds while several automata pass over them, one at a time.
HELD_BYTES = 64_000_000
#: A-Z to a-z; 0-9, a-z and every byte of a character beyond ASCII stay; all else is a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """All runs of ``size`` words; fewer words are one window, none give none."""
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Automaton:
    def __init__(self, items: tuple[tuple[str, str], ...], size: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(words_of(text), size):
                owners.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, own in owners.items():
            # latin-1 makes a character of each byte, so the offsets stay those of bytes
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w), w.count(b" ") + 1, tuple(sorted(own))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, tuple[str, ...]]], list[bytes]]:
        """(number of words, [(first word, end word, items)] of all occurrences, words)."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], words
        flat = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(flat))
        if not found:
            return len(words), [], words
        starts = np.cumsum([1, *(len(w) + 1 for w in words)])
        out = []
        for end, (length, n, own) in found:
            first = int(np.searchsorted(starts, end - length))
            out.append((first, first + n, own))
        return len(words), out, words


@functools.lru_cache(1)
def _automaton(items: tuple[tuple[str, str], ...], size: int) -> Automaton:
    return Automaton(items, size)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[tuple[str, str], ...]]:
    """The benchmark's items, one block after another; the number of blocks is not limited."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    block, size = [], 0
    for i, t in rows.toLocalIterator():
        block.append((i, t))
        size += len(t.encode())
        if size >= block_bytes:
            yield tuple(sorted(block))
            block, size = [], 0
    yield tuple(sorted(block))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: words, words hit, items found and their places in the original text.

    Columns doc_id, n_words, n_hit, n_items, items (sorted strings), spans
    (array of start, end in code points of the original text, overlapping windows
    joined) and contaminated.

    A null text or item has no words and is neither hit nor found; a document without
    words is clean; an empty benchmark leaves all clean. Items with the same words are all
    found; an item with a null id is found as "". Repeated rows of documents give a row each,
    texts of any length are scanned whole. Extra columns are not read.

    What is broadcast at a time is one block of items of at most ``block_bytes`` (and one item); the
    driver reads the benchmark block by block. Documents are read once and never rewritten: with
    several blocks a task holds some of its documents, and one automaton after another, of which
    it keeps one, passes over them.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    got = rows.mapInArrow(_scanned(blocks, window), "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
    return got.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def _held(batches, most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of up to 512 rows, or of rows with ``most`` bytes if that is not 0."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids += part.column(0).to_pylist()
            texts += part.column(1).to_pylist()
            size += part.nbytes
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _scanned(blocks: list, window: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        order = list(range(len(blocks)))
        for ids, texts in _held(batches, HELD_BYTES if len(blocks) > 1 else 0):
            found: list[list] = [[] for _ in ids]
            n = [0] * len(ids)
            for k in order:
                auto = _automaton(blocks[k].value, window)
                for i, t in enumerate(texts):
                    n[i], more, _ = auto.scan(t)
                    found[i] += more
            order.reverse()  # the automaton that is held comes first
            got = [(i, m, *(_digest(t, f) if f else (0, [], []))) for i, t, m, f in zip(ids, texts, n, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    return run


def _digest(text: str, found: list[tuple[int, int, tuple[str, ...]]]):
    """(words hit, sorted items, spans in the original) of a text's occurrences."""
    merged: list[list[int]] = []
    for a, b, _ in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    raw = text.encode()
    ends = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_TABLE))]
    spans = []
    for a, b in merged:
        start = len(raw[: ends[a][0]].decode())
        spans.append({"start": start, "end": start + len(raw[ends[a][0] : ends[b - 1][1]].decode())})
    return sum(b - a for a, b in merged), sorted({i for _, _, own in found for i in own}), spans


def items_sha256(items: str = "items"):
    return F.sha2(F.concat_ws(",", F.col(items)), 256)
