"""Merkle manifest of a dataset: leaves, subroots of sources, one root, and proofs of every row.

Checkpoint and recompute: of a tree's levels only every second one is stored, as blocks of 256
consecutive digests. A block and the number of nodes of its level are enough to make the one level between
again, so proofs are extracted block by block from the top: the interior nodes of a block are made from its stored
digests, the siblings of each of its nodes are put before those of the block's own path, and the
interior nodes are gone when the block is done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.llm.common import discard, written

#: Children of a node, and the digests of a stored block: SPAN of SPAN, so every second level is stored.
SPAN = 16
BLOCK = SPAN * SPAN
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<run:array<string>,own:int>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes' number, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    return digest(*[encoded(text if f == "text" else F.col(f)) for f in fields])


def tampered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def numbered(rows: DataFrame, order: list[str], dear: bool = True) -> DataFrame:
    """``rows`` with ``at``, each one's place from 0 on in its ``tree`` by ``order``, and the tree's ``size``.

    Rows are dealt by ranges, so a tree of any size is spread over tasks; each task's rows of a tree are numbered by
    what the tasks before it have of the tree. Rows that are equal in all of ``order`` are numbered in any order.
    Rows that are ``dear`` to make are written first, as ranges are found by making them once more.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    first = written(rows, "unordered") if dear else rows
    keys = ["tree", *order, "_row"]
    dealt = first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_id", 33))
    if dear:
        discard(first)
    # one row for each task and tree that it has rows of
    pieces = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return dealt.join(pieces, ["tree", "_part"]).withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """Nodes of one level (tree, at, size, digest and ``extra``) as stored blocks: (tree, block, size, nodes)."""
    node = F.struct("at", "digest", *extra)
    packed = nodes.groupBy("tree", F.shiftright("at", 8).alias("block")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(node)).alias("nodes"))
    return written(packed, "blocks")


def _runs(digests: Column) -> Column:
    """The runs of ``SPAN`` digests that a block has."""
    return F.transform(F.sequence(F.lit(0), ((F.size(digests) - 1) / SPAN).cast("int")), lambda k: F.slice(digests, k * SPAN + 1, SPAN))


def _between(digests: Column) -> Column:
    """The level between two stored ones, of one block."""
    return F.transform(_runs(digests), lambda run: digest(F.array_join(run, "")))


def _upper(b: DataFrame) -> DataFrame:
    """Blocks to the nodes of the next stored level, of the trees that have not come to their top."""
    mid = _between(F.col("nodes.digest"))
    node = F.when(F.col("size") <= SPAN, mid[0]).otherwise(digest(F.array_join(mid, "")))
    size = F.when(F.col("size") <= SPAN, 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("long")
    return b.where("size > 1").select("tree", F.col("block").alias("at"), size.alias("size"), node.alias("digest"))


def stored(leaves: DataFrame, extra: list[str]) -> list[DataFrame]:
    """The stored levels of all trees, from the leaves up, until every tree has come to one node."""
    levels = [blocks(leaves, extra)]
    while not levels[-1].where("size > 1").isEmpty():
        levels.append(blocks(_upper(levels[-1]), []))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's last node."""
    out = None
    for b in levels:
        top = b.where("size = 1").select("tree", F.col("nodes")[0]["digest"].alias("digest"))
        out = top if out is None else out.unionByName(top)
    return out


def _each(f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of every node of a block and its path: siblings with its place among them, from its level up.

    Goes over a block's columns nodes, size and path, which is the block's own. What all nodes share is made once a block.
    """
    step = lambda run, own: F.struct(run.alias("run"), own.cast("int").alias("own"))

    def path(x: Column, shared: Column) -> Column:
        place = x["at"].cast("long") % BLOCK
        low = step(F.slice(shared["digests"], (place - place % SPAN + 1).cast("int"), SPAN), place % SPAN)
        high, size = step(shared["between"], F.floor(place / SPAN)), F.col("size")
        own = F.when(size <= 1, F.array().cast(PATH)).when(size <= SPAN, F.array(low)).otherwise(F.array(low, high))
        return F.concat(own, F.col("path"))

    digests = F.col("nodes.digest")
    once = F.array(F.struct(digests.alias("digests"), _between(digests).alias("between")))
    return F.inline(F.transform(once, lambda shared: F.transform("nodes", lambda x: f(x, path(x, shared))))[0])


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the leaves, each with its ``path`` and what ``above`` (tree, path and more) has of its tree.

    Goes down the stored levels: a block's path is that of the node which it makes, found with the block above.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    over = None
    for k in reversed(range(len(levels))):
        top = above.join(levels[k].where("size = 1").select("tree"), "tree").withColumn("block", F.lit(0).cast("long"))
        over = top if over is None else over.unionByName(top)
        b = levels[k].join(over, ["tree", "block"])
        if k:
            each = _each(lambda x, path: F.struct(x["at"].alias("block"), path.alias("path")))
            over = written(b.select("tree", *carried, each), "paths")
    return b


def siblings(path: Column) -> Column:
    """The siblings of a path in one text, level by level, left to right."""
    others = lambda p: F.concat(F.slice(p["run"], F.lit(1), p["own"]), F.slice(p["run"], p["own"] + 2, F.lit(SPAN)))
    return F.array_join(F.transform(path, lambda p: F.array_join(others(p), "")), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    left = lambda p: F.array_join(F.slice(p["run"], F.lit(1), p["own"]), "")
    right = lambda p: F.array_join(F.slice(p["run"], p["own"] + 2, F.lit(SPAN)), "")
    return F.aggregate(path, start, lambda acc, p: digest(left(p), acc, right(p)))


@dataclass
class Manifest:
    """Stored levels of the sources' trees and of the tree over their subroots."""

    sources: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build(docs: DataFrame, tampered_rows: Column | None = None) -> Manifest:
    """The manifest of a table with the columns of ``FIELDS``; others are not read.

    A leaf is a row's digest; per source leaves ascend by doc_id (null first; equal ids by their digest), sources by
    name (null first, bytewise). A null in any column is a ``-``, an empty text ``0:``, texts of any length are
    hashed whole. Repeated rows are leaves of their own. An empty table has no root. With
    ``tampered_rows`` the leaves also hold the digest of the tampered text where it is true.
    """
    source = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    other = F.when(tampered_rows if tampered_rows is not None else F.lit(False), leaf(tampered(F.col("text"))))
    rows = docs.select(source.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), other.alias("other"))
    sources = stored(numbered(rows, ["doc_id", "digest"]), ["doc_id", "other"])
    subroots = tops(sources).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    top = stored(numbered(subroots, ["source"]), ["source"])
    found = tops(top).first()
    return Manifest(sources, top, found and found["digest"])


def proofs(m: Manifest, spark) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of the manifest."""
    start = spark.createDataFrame([("", [])], f"tree string, path {PATH}")
    each = _each(lambda x, path: F.struct(x["source"].alias("tree"), x["digest"].alias("subroot"), path.alias("path")))
    above = written(with_paths(m.top, start).select(each), "above")

    def proof(x: Column, path: Column) -> Column:
        made = folded(F.coalesce(x["other"], x["digest"]), path)
        return F.struct(x["doc_id"].alias("doc_id"), x["digest"].alias("leaf"), F.sha2(siblings(path), 256).alias("proof_sha256"), made.alias("folded_root"))

    rows = with_paths(m.sources, above).select("subroot", _each(proof))
    return rows.select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(m.root)).alias("verified"))


def tamper_choice(id_col: str = "doc_id", by: int = 5) -> Column:
    """Rows whose id's checksum is divisible by ``by``; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % by == 0, F.lit(False))


def manifest(docs: DataFrame) -> DataFrame:
    """Builds the manifest of ``docs`` and proves every row, those of :func:`tamper_choice` with a tampered text.

    Tampering lower-cases A-Z, so a text without them (or a null) is not changed and still verifies.
    """
    return proofs(build(docs, tamper_choice()), docs.sparkSession)
