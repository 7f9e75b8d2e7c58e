"""Near-duplicates (operator 4): BagMinHash signatures, banding, verified multiset overlap.

A text is the multiset of its five-word shingles. Every shingle owns a hierarchy of Poisson
processes over its weight axis, one for each interval [0,1), [1,2), [2,4), [4,8) ... with
the interval's length as rate. A point has a time, a register and a place on the axis, all
drawn from a hash of shingle, interval and number, so that it is the same point in every
text; a text of weight w has the points whose place is below w. A register keeps the
earliest point; two texts agree in a register with the probability of their weighted
Jaccard similarity. Points later than the latest register cannot change anything, so
only about k ln k points are made for a text beyond the first of each process.

Texts that agree in all registers of a band are candidates. Candidates are verified by
the exact overlap of their multisets, and verified links make groups.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import discard, join_hot, only, with_groups, with_lookup, written

SHINGLE, SIMILAR = 5, 0.8
#: 24 bands of 5 registers: a pair of similarity 0.8 is missed with probability 7e-5.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Members that one task verifies against one text at most; more are dealt over more tasks.
SALT_ROWS = 200
#: Buckets of up to so many texts are compared pair by pair, larger ones in blocks.
SMALL = 4
#: Shingles of the texts in a block, and in a block of visitors, about.
BLOCK_SHINGLES, VISIT_SHINGLES = 60_000, 300_000
_WORD = re.compile(r"[^\W_]+")
MEMO = 400_000
_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a public bijective hash of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_ROLL = mix(np.arange(1, SHINGLE + 1, dtype=_U) * _GOLD) | _U(1)


class Shingler:
    def __init__(self):
        self.memo: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        """64-bit hashes of a text's words."""
        found, memo = _WORD.findall(text.lower()) if text else [], self.memo
        try:
            return np.array([memo[w] for w in found], _U)
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in set(found).difference(memo):
                memo[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            return np.array([memo[w] for w in found], _U)

    def shingles(self, text: str | None) -> np.ndarray:
        """Hashes of all runs of five words; a text of fewer, but not none, is one shingle."""
        h = self.words(text)
        if not len(h):
            return h
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, _U)
        for k in range(min(SHINGLE, len(h))):
            out += h[k : k + n] * _ROLL[k]
        return mix(out)

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.shingles(text), return_counts=True)


@functools.lru_cache(1)
def shingler() -> Shingler:
    return Shingler()


def _draw(seed: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """m hashes from number ``first`` on of each process: processes x m."""
    i = first[:, None] + np.arange(m, dtype=_U)[None, :]
    return mix(seed[:, None] + (i + _U(1)) * _GOLD)


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, k: int = REGISTERS) -> np.ndarray:
    """n_docs x k registers (times as 64-bit patterns) of bags given as sorted (doc, item, weight).

    Documents without items keep infinite registers.
    """
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    level = np.zeros(len(doc), np.int64)
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    many = np.flatnonzero(top > 0)
    if len(many):  # an item of weight over 1 has more intervals: [2**(j-1), 2**j) for j = 1 to top
        extra = np.repeat(many, top[many])
        step = np.arange(len(extra)) - np.repeat(np.cumsum(top[many]) - top[many], top[many]) + 1
        doc, item, weight, level = np.r_[doc, doc[extra]], np.r_[item, item[extra]], np.r_[weight, weight[extra]], np.r_[level, step]
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, low, 1.0)
    seed = mix(item + level.astype(_U) * _M2)
    sig = np.full(n_docs * k, np.inf)
    limit = np.full(n_docs, 0.0)
    open_docs = total > 0
    limit[open_docs] = k / total[open_docs] * (np.log(k) + 4)
    todo = open_docs
    while todo.any():
        live = np.flatnonzero(todo[doc])
        t, number, m = np.zeros(len(live)), np.zeros(len(live), _U), 1
        while len(live):
            u = _draw(seed[live], number, m)
            at = t[:, None] + np.cumsum(-np.log(((u >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / rate[live][:, None]
            r, ok = mix(u ^ _GOLD), at < limit[doc[live]][:, None]
            place = low[live][:, None] + (mix(r) >> _U(11)).astype(np.float64) * 2.0**-53 * rate[live][:, None]
            ok &= place < weight[live][:, None]
            p, q = np.nonzero(ok)
            if len(p):
                np.minimum.at(sig, doc[live[p]] * k + (r[p, q] % _U(k)).astype(np.int64), at[p, q])
                latest = sig.reshape(n_docs, k).max(axis=1)
                limit = np.where(np.isfinite(latest), np.minimum(limit, latest), limit)
            t, number = at[:, -1], number + _U(m)
            stay = t < limit[doc[live]]
            live, t, number, m = live[stay], t[stay], number[stay], 8
        todo = open_docs & ~np.isfinite(sig.reshape(n_docs, k)).all(axis=1)
        limit[todo] *= 2  # a register is still empty: the same points again and later ones
    return sig.reshape(n_docs, k).view(_U)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """docs x bands: a hash of each band's registers."""
    parts = mix(sig.reshape(len(sig), BANDS, ROWS) + np.arange(ROWS, dtype=_U) * _GOLD)
    return mix((parts * _ROLL[:ROWS]).sum(axis=2, dtype=_U) + np.arange(BANDS, dtype=_U) * _M1)


def _sketched(batches):
    own = shingler()
    for b in batches:
        for at in range(0, b.num_rows, 128):
            part = b.slice(at, 128)
            texts = part.column(1).to_pylist()
            bags = [own.bag(t) for t in texts]
            sizes = np.array([len(x) for x, _ in bags])
            doc = np.repeat(np.arange(len(bags)), sizes)
            item, count = np.concatenate([x for x, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64)
            keys = band_keys(signatures(doc, item.astype(_U), count.astype(np.float64), len(bags))).view(np.int64)
            c = count.astype(_U)
            marks = []
            for salt in (_GOLD, _M2):
                sums = np.zeros(len(bags), _U)
                np.add.at(sums, doc, mix(mix(item.astype(_U) ^ salt) + c * _M1))
                marks.append(sums)
            for i, t in enumerate(texts):
                if not sizes[i]:  # no word: equal texts are copies, all else is alone
                    d = hashlib.blake2b((t or "").encode(), digest_size=16).digest() if t and not t.isspace() else bytes(16)
                    marks[0][i], marks[1][i] = np.frombuffer(d, _U)
            n = np.bincount(doc, weights=count, minlength=len(bags)).astype(np.int64)
            bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32), pa.array(keys[sizes > 0].ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), pa.array(n), bands], names=["id", "mark1", "mark2", "n", "bands"])


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark1, mark2, n, bands): marks are equal for equal bags; n shingles; 24 band keys."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketched, "id long, mark1 long, mark2 long, n long, bands array<long>")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted items, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = np.where(a[0][at] == b[0], np.minimum(a[1][at], b[1]), 0).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _verified(least: float):
    def run(batches):
        own, hub, bag = shingler(), None, None
        for b in batches:
            out = []
            for a, i, text in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                if i == a:  # a hub's own row comes first
                    hub, bag = a, own.bag(text)
                elif hub == a and (s := jaccard(bag, own.bag(text))) >= least:
                    out.append((a, i, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "similarity"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough, with their similarity.

    b's text goes to a's; a text with many partners is sent to as many tasks as its partners
    need, so that no task holds more than some of them, and one text at a time.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    counted = with_groups(pairs, ["a"], {"salts": F.ceil(F.count("*") / SALT_ROWS).cast("int")})
    asked = counted.select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    asked = asked.unionByName(hubs.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    rows = asked.join(texts, "id").withColumn("role", (F.col("id") != F.col("a")).cast("int"))
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id")
    return dealt.select("a", "id", "text").mapInArrow(_verified(least), "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(id, group): the least id connected with each id of the links (a, b).

    Alternates large-star and small-star steps, each a grouping and a join of the links
    that are left; every step's result is written, and the loop ends when none changes.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        old, edges = edges, written(small.distinct(), "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("group"))
        mark = now


def _links(least: float):
    def run(batches):
        own, at, rows = shingler(), None, []
        for b in batches:
            out = []
            for *place, i, group, side, text in zip(*[b.column(k).to_pylist() for k in range(8)], strict=True):
                if place != at:
                    out += block_links(rows, least)
                    at, rows = place, []
                rows.append((i, group, side, own.bag(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        if out := block_links(rows, least):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def block_links(rows: list[tuple], least: float) -> list[tuple[int, int]]:
    """Links that connect what is similar among (id, group, side, bag): compares the groups of side 0 with those of side 1.

    An index from shingles to texts
    gives one text's overlap with all others at once; texts that are connected by now are left
    out, so at most one link fewer than texts comes out.
    """
    if len(rows) < 2:
        return []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    sizes = np.array([r[3][1].sum() for r in rows])
    sides = np.array([r[2] for r in rows])
    items = np.concatenate([r[3][0] for r in rows])
    counts = np.concatenate([r[3][1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[3][0]) for r in rows])
    order = np.argsort(items, kind="stable")
    items, counts, owner = items[order], counts[order], owner[order]
    out = []
    for i, (a, group, side, bag) in enumerate(rows[:-1]):
        lo, hi = np.searchsorted(items, bag[0], "left"), np.searchsorted(items, bag[0], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], weights=np.minimum(np.repeat(bag[1], n), counts[at]), minlength=len(rows))
        alike = (both >= least * (sizes + sizes[i] - both) - 1e-9) & (sides != side)
        alike[: i + 1] = False
        for k in np.flatnonzero(alike).tolist():
            x, y = root(group), root(rows[k][1])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, rows[k][0]))
    return out


def crowded(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between groups inside bands' buckets of many texts (band, key, id, n, group, total, top, rest).

    ``top`` is the bucket's largest group, whose texts need not meet each other, and ``rest`` the
    shingles of all others. Every text stays in a block of bounded size, and the texts outside
    ``top``, in blocks of their own, visit each of them; a task compares one block with one block of
    visitors. So a bucket costs (texts x blocks of visitors) + (visitors x blocks) rows: where
    nearly all belong together already, about one row a text.
    """
    own, visit = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int"), F.ceil(F.col("rest") / VISIT_SHINGLES).cast("int")
    rows = members.withColumns({"blocks": own, "visits": F.greatest(visit, F.lit(1)), "salt": F.xxhash64("id")})
    here = rows.select("band", "key", F.pmod("salt", "blocks").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("visits").cast("long") - 1)).alias("y"), "id", "group", F.lit(0).alias("side"))
    there = rows.where("group <> top").select("band", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("x"), F.pmod("salt", "visits").alias("y"), "id", "group", F.lit(1).alias("side"))
    place = ["band", "key", "x", "y"]
    dealt = here.unionByName(there).join(texts, "id").repartition(*place).sortWithinPartitions(*place, "id", "side")
    return dealt.select(*place, "id", "group", "side", "text").mapInArrow(_links(least), "a long, b long")


def grouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))


def near_duplicates(docs: DataFrame, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, group_id) of every row.

    class_id is the least id with an equal bag of shingles; group_id the least id of all that
    are connected by verified links of similarity ``least`` or more. Texts of fewer than
    five words are one shingle. Texts without a word are equal only to the same text; null, empty
    and blank texts are alone. Texts of any length are compared whole. Ids are taken to identify
    texts; each repeated row has the result of its id. A null id's row gets the class and group of its
    copies, null if there are none. An empty table gives no rows; other columns are not read.

    First every text is compared with the most central text of its bands, then with those of each
    of its bands that it is not yet connected with, at last with every text that shares a band
    with it and is in another group so far. So a group of n near copies around an original
    costs about n comparisons, and no candidate pair of different groups is left out. The last
    step makes pairs only in buckets of a few texts; larger ones are compared in blocks. Copies and
    buckets are told their least id and their centre so that no task gets a hot group.
    """
    sketches = written(sketch(docs, id_col, text_col), "sketches")
    n_rows = sketches.count()
    alone = (F.col("mark1") == 0) & (F.col("mark2") == 0) & (F.col("n") == 0)
    marks = sketches.where(~alone).select("id", "mark1", "mark2")
    told = with_groups(marks, ["mark1", "mark2"], {"rep": F.min("id")}, "_rows > 1", "left", n_rows)
    classes = told.select("id", F.coalesce("rep", "id").alias("rep")).unionByName(sketches.where(alone).select("id", F.col("id").alias("rep")))
    classes = written(classes, "classes")

    copies = classes.where("id <> rep").select("id").distinct()
    banded = sketches.where((F.size("bands") > 0) & F.col("id").isNotNull()).join(copies, "id", "left_anti").dropDuplicates(["id"])
    entries = banded.select("id", "n", F.posexplode("bands").alias("band", "key"))
    found = entries = written(with_groups(entries, ["band", "key"], {"size": F.count("*")}, "size > 1", total=n_rows * BANDS), "entries")
    # the more a text shares bands with others, the more central it is in its group
    central = found.groupBy("id").agg(F.sum("size").alias("degree"))
    found = found.join(central, "id").drop("size")
    found = degrees = written(found, "degrees")
    hub = F.max(F.struct("degree", (-F.col("id")).alias("minus")))
    members = written(with_groups(found, ["band", "key"], {"hub": hub}), "members")
    discard(sketches, entries, degrees)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = written(only(texts, members.select("id"), "id"), "texts")

    best = members.where("id <> -hub.minus").groupBy("id").agg(F.max("hub").alias("hub"))
    first = written(verify(best.select(F.col("id").alias("b"), (-F.col("hub.minus")).alias("a")), texts, least).select("a", "b"), "links")
    groups = components(first)

    known = grouped(members, groups)
    all_hubs = known.select(F.col("id").alias("b"), (-F.col("hub.minus")).alias("a"), F.col("group").alias("group_b")).where("a <> b").distinct()
    of_hub = groups.select(F.col("id").alias("a"), F.col("group").alias("group_a"))
    again = with_lookup(written(all_hubs, "hubs"), "a", of_hub).where(F.coalesce("group_a", "a") != F.col("group_b")).select("a", "b")
    again = again.join(best.select(F.col("id").alias("b"), (-F.col("hub.minus")).alias("a")), ["a", "b"], "left_anti")
    again = written(again, "again")
    second = written(verify(again, texts, least).select("a", "b"), "links2")
    links = first.unionByName(second)
    groups = components(links)

    known = written(grouped(members, groups).select("band", "key", "id", "n", "group"), "known")
    # of each bucket with two groups or more: its texts, shingles, largest group and the shingles of the rest
    sized = known.groupBy("band", "key", "group").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    largest = F.max_by(F.struct("group", "total"), F.struct("total", "group"))
    mixed = sized.groupBy("band", "key").agg(F.count("*").alias("groups"), F.sum("m").alias("m"), F.sum("total").alias("total"), largest.alias("top")).where("groups > 1")
    mixed = mixed.select("band", "key", "m", F.col("m").alias("_rows"), "total", F.col("top.group").alias("top"), (F.col("total") - F.col("top.total")).alias("rest"))
    left = written(join_hot(known, written(mixed, "mixed"), ["band", "key"]), "left")
    few = left.where(F.col("m") <= SMALL)
    other = few.select("band", "key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("group").alias("group_b"))
    near = F.least("n", "n_b") >= least * F.greatest("n", "n_b")
    rest = few.join(other, ["band", "key"]).where((F.col("id") < F.col("b")) & (F.col("group") != F.col("group_b")) & near).select(F.col("id").alias("a"), "b").distinct()
    pairs = written(rest, "pairs")
    more = verify(pairs, texts, least).select("a", "b").unionByName(crowded(left.where(F.col("m") > SMALL), texts, least))
    more = written(more, "more")
    groups = components(links.unionByName(more))

    discard(texts, members, known, left, pairs, more, first, again, second)
    out = with_lookup(classes, "rep", groups.select(F.col("id").alias("rep"), "group"))
    return out.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("group", "rep").alias("group_id"))
