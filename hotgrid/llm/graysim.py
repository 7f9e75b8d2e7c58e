"""SimHash near-duplicates: an exact search for fingerprints that differ in few bits, and what they connect.

Fingerprints are dealt into buckets that agree in two of five bit blocks, as any two with at most three differing bits do
in some bucket; a bucket of many is split in the same way by the bits that are left. In a bucket the
fingerprints are sorted by their rank in the Gray code, so that neighbours share long bit patterns, and a tree is laid over
them: a node holds the bits that all below it have in common and its parent does not say yet. A fingerprint goes down
the tree, adds up its differences from the patterns on its way, and leaves a whole group once they are too many.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import discard, map_texts, with_groups, with_lookup, written
from hotgrid.llm.neardup import components

#: Differing bits that linked fingerprints have at most, words of a shingle and the seed of its hash.
DIFFERENT, WORDS, SEED = 3, 3, 42
#: Fingerprints that one bucket's tree holds at most; larger buckets are split.
BUCKET = 4096
#: Children of a node, rows that are searched at once, and those that go down the trees together.
FAN, TOGETHER, QUERIES = 8, 32_768, 1024
#: Hashes of one text that are counted at once.
HASHES = 65_536
U64 = np.uint64

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text: a bit is set if it is in over half of the hashes of its shingles."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    last = max(len(words) - WORDS + 1, 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, last, HASHES):
        own = words[i : min(i + HASHES, last) + WORDS - 1]
        grams = zip(*[own[k:] for k in range(WORDS)], strict=False) if len(words) >= WORDS else [own]
        hashes = np.fromiter(map(_hash, map(b" ".join, grams)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, the fingerprint as a signed long."""

    def start():
        return lambda ids, texts: {"id": ids, "fp": np.array([fingerprint(t) for t in texts], U64).view(np.int64)}

    return map_texts(docs, start, pa.schema([("id", pa.int64()), ("fp", pa.int64())]), "id long, fp long", id_col, text_col)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the order of the Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(k))
    return x


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the rows a and b of each link, and what is connected with them, the least label of them all."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (up := label[label])).any():
            label[:] = up


class Trees:
    """Trees over the Gray-sorted fingerprints of several buckets, level by level; a row is a node of level 0."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        order = np.lexsort((gray_rank(fps), bucket))
        self.fps, bucket = fps[order], bucket[order]
        new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[new, len(fps)])
        place = np.arange(len(fps)) - np.repeat(new, size)
        #: per row, the level of its bucket's root
        self.top = np.repeat(np.ceil(np.log(np.maximum(size, 2)) / np.log(FAN) - 1e-9).astype(int), size)
        self.starts, common = [np.arange(len(fps))], [~np.zeros(len(fps), U64)]
        for k in range(1, self.top.max(initial=1) + 1):
            at = np.flatnonzero(place % FAN**k == 0)
            first = np.repeat(self.fps[at], np.diff(np.r_[at, len(fps)]))
            self.starts.append(at)
            common.append(~np.bitwise_or.reduceat(self.fps ^ first, at))
        #: per level, the bits that a node tells and no node above it
        self.bits = []
        for k, own in enumerate(common):
            above = np.zeros(len(own), U64)
            if k + 1 < len(common):
                parent = np.searchsorted(self.starts[k + 1], self.starts[k], "right") - 1
                above = np.where(k >= self.top[self.starts[k]], U64(0), common[k + 1][parent])
            self.bits.append(own & ~above)

    def links(self, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, later row of its bucket) that differ in at most ``most`` bits."""
        q, node, acc = (np.zeros(0, int) for _ in range(3))
        for k in range(len(self.starts) - 1, -1, -1):
            starts, ends = self.starts[k], np.r_[self.starts[k][1:], len(self.fps)]
            if k:
                enter = rows[self.top[rows] == k]
                q, acc = np.r_[q, enter], np.r_[acc, np.zeros(len(enter), int)]
                node = np.r_[node, np.searchsorted(starts, enter, "right") - 1]
            acc = acc + np.bitwise_count((self.fps[q] ^ self.fps[starts[node]]) & self.bits[k][node])
            keep = (acc <= most) & (ends[node] > q + 1)
            q, node, acc = q[keep], node[keep], acc[keep]
            if k:
                low = np.searchsorted(self.starts[k - 1], starts[node])
                n = np.searchsorted(self.starts[k - 1], ends[node]) - low
                child = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, node, acc = np.repeat(q, n), child, np.repeat(acc, n)
        return q, node


def search(fps: np.ndarray, bucket: np.ndarray, most: int = DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all fingerprints of a bucket that links of ``most`` bits connect; fewer than rows."""
    trees = Trees(fps, bucket)
    label = np.arange(len(fps))
    for i in range(0, len(fps), QUERIES):
        connect(label, *trees.links(np.arange(i, min(i + QUERIES, len(fps))), most))
    rest = np.flatnonzero(label != np.arange(len(fps)))
    return trees.fps[label[rest]], trees.fps[rest]


def _searched(most: int):
    """Buckets (mask, key, fp), sorted, to links: some whole buckets at once."""

    def found(mask, key, fp):
        new = np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        a, b = search(fp.view(U64), np.cumsum(new), most)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.r_[h, batch.column(i).to_numpy()] for i, h in enumerate(held)]
            if len(held[0]) >= TOGETHER:
                mask, key, _ = held
                cut = np.flatnonzero((mask != mask[-1]) | (key != key[-1])).max(initial=-1) + 1  # the last bucket may go on
                yield from found(*[h[:cut] for h in held]) if cut else ()
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield from found(*held)

    return run


def _cut(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` blocks of about as many of the bits each."""
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:], strict=False)]


def masks(within: int | None = None, most: int = DIFFERENT) -> list[int]:
    """Masks of which any two fingerprints with at most ``most`` differing bits agree in one, whole.

    At first two of ``most`` + 2 blocks; within a mask, it and one of ``most`` + 1 blocks of the other bits.
    """
    if within is None:
        return [a | b for a, b in combinations(_cut(list(range(64)), most + 2), 2)]
    return [within | m for m in _cut([b for b in range(64) if not within >> b & 1], most + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, most: int = DIFFERENT, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of distinct fingerprints (fp) that connect exactly what links of ``most`` differing bits connect.

    Buckets over ``bucket`` are dealt again by more bits. Distinct fingerprints that agree in all but n bits are at most 2^n, so
    this ends: with three bits, 39 bits are left at first, then 30, 23, 18, 14 and 11 at most. Every round's masks are a fixed list, 10
    times 4 a round.
    """
    if bucket < 1 << most:
        raise ValueError(f"a bucket must hold {1 << most} fingerprints")
    kinds, out = masks(most=most), None
    each = lambda of: F.explode(F.array(*[F.lit(_signed(m)) for m in of]))
    rows = fps.select("fp", each(kinds).alias("mask"))
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        rows = written(with_groups(rows, ["mask", "key"], {"size": F.count("*")}, "_rows > 1"), "buckets")
        small = rows.where(F.col("size") <= bucket).select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
        got = written(small.mapInArrow(_searched(most), "a long, b long").distinct(), "links")
        out = got if out is None else out.unionByName(got)
        large = rows.where(F.col("size") > bucket)
        if large.isEmpty():
            return out
        inner = {m: masks(m, most) for m in kinds}
        table = fps.sparkSession.createDataFrame([(_signed(m), _signed(c)) for m, cs in inner.items() for c in cs], "mask long, child long")
        rows = large.join(F.broadcast(table), "mask").select("fp", F.col("child").alias("mask")).distinct()
        kinds = sorted({c for cs in inner.values() for c in cs})


def near_duplicates(docs: DataFrame, most: int = DIFFERENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, repeated ones too.

    Texts are taken whole and compared by words, A-Z in lower case. Texts with fewer than three words are one shingle; those
    without any (null, empty, blank) have the fingerprint zero, which is linked like any other. component_id is
    the least id that links of at most ``most`` bits reach, null if no row there has an id. An empty
    table gives no rows; other columns are not read.

    Rows with equal fingerprints are one in the search; the number of rows is met again only when they are told
    their component, where fingerprints that many rows have are broadcast.
    """
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = links(fps, most)
    groups = components(linked).select(F.col("id").alias("fp"), "group")
    named = written(fps.join(groups, "fp", "left").select("fp", "least", F.coalesce("group", "fp").alias("group")), "named")
    told = with_groups(named, ["group"], {"component_id": F.min("least")})
    out = with_lookup(marked, "fp", told.select("fp", "component_id"))
    discard(fps)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
