"""Best-fit packing (operator 5) with certified bounds and repacking.

Documents are cut into pieces of at most one sequence. Pieces are dealt to bounded
parts; each part is packed by best-fit decreasing and gets a lower bound from
dual-feasible functions. A part that needs as many bins as its bound is certified
optimal and left alone. The pieces in unfilled bins of the other parts are pooled,
dealt anew and packed again, and a new packing replaces the old where it needs fewer bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import map_texts, written
from hotgrid.llm.tokens import crc32, id_encoder

CAPACITY = 2048
#: Pieces in a part, on average; what a task holds is a few dozen bytes for each.
PART = 100_000
ROUNDS = 2
END = (0).to_bytes(4, "little")


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the id 0 after them.

    Only documents of over ``capacity`` ids are cut. A null or empty text is the id 0 alone.
    """
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def start():
        encode, step = id_encoder(path).encode, 4 * capacity

        def f(ids, texts):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                b = (encode(t) if t else b"") + END
                rows += [(i, at // step, at // 4, min(step, len(b) - at) // 4, crc32(b[at : at + step])) for at in range(0, len(b), step)]
            return dict(zip(out.names, map(list, zip(*rows, strict=True)), strict=True))

        return f

    return map_texts(df, start, out, "doc_id long, piece int, start long, length long, ids_crc32 long", id_col, text_col)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the dual-feasible functions' bounds on the number of bins.

    The identity, the threshold functions (a piece of over capacity - e counts whole, one of
    under e not at all) and the rounding functions u(k).
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total, count = np.concatenate([[0], np.cumsum(n * size)]), np.concatenate([[0], np.cumsum(n)])
    e = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - e + 1]
    mid = total[capacity - e + 1] - total[e]
    best = max(-(-int(total[-1]) // capacity), int((large + -(-mid // capacity)).max()))
    for k in range(1, 101):
        x = (k + 1) * size
        u = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)  # k * capacity times the function
        best = max(best, -(-int((n * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the bins' fill. Ties keep the order of the input."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with r free tokens is there
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        rest = mask >> size
        if rest:
            r = size + (rest & -rest).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if r > size:
            free[r - size].append(b)
            mask |= 1 << (r - size)
    return bins, offsets, np.array(fill, np.int64)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long, gap long"


def _pack(capacity: int):
    def f(part: pa.Table) -> pa.Table:
        # the order of the rows of a group is not fixed; the packing has to be
        part = part.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        lengths = part["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        base = part.select(["doc_id", "piece", "start", "length", "ids_crc32", "part"])
        for name, x in (("bin", bins), ("offset", offsets), ("fill", fill[bins]), ("gap", np.full(len(lengths), gap))):
            base = base.append_column(name, pa.array(x, pa.int64()))
        return base

    return f


def _dealt(df: DataFrame, parts: int, seed: int) -> DataFrame:
    """Deal pieces to parts by a hash that spreads every size evenly over them."""
    return df.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), F.lit(parts)))


def pack(found: DataFrame, capacity: int = CAPACITY, part_rows: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences.

    Adds sequence_id and offset; offsets of a sequence run gapless from 0. Pieces of equal
    length are placed by their id, so the result is the same on each run. Rows that repeat
    are all placed. An empty table gives no sequence.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = written(found.select(*names), "pieces")  # tokens are made once; all that follows is small
    parts = max(1, -(-found.count() // part_rows))
    done, pool, level = [], found, 0
    for level in range(rounds + 1):
        packed = written(_dealt(pool, parts, level).groupBy("part").applyInArrow(_pack(capacity), _PACKED), f"packed{level}")
        placed = packed.withColumn("sequence_id", (F.col("part") * (rounds + 1) + level) * F.lit(1 << 32) + F.col("bin"))
        again = (F.col("gap") > 0) & (F.col("fill") < capacity)
        if level:
            before, now = [x.select("sequence_id").distinct().count() for x in (pool, placed)]
            if now >= before:
                break
        if level == rounds or not (n := placed.where(again).count()):
            done.append(placed)
            pool = None
            break
        done.append(placed.where(~again))
        pool, parts = placed.where(again).select(*names, "sequence_id", "offset"), max(1, -(-n // (2 * part_rows)))
    if pool is not None and level:
        done.append(pool)
    out = [x.select(*names, "sequence_id", "offset") for x in done]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(df, path, capacity, id_col, text_col), capacity)
