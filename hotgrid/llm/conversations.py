"""Repair of conversations' structure at the least cost.

A conversation is read as rows in the order of their turns, and its roles have to be an optional system row and then
user and assistant by turns. Blocks of consecutive rows are solved apart, for every state that a block may be entered and
left in, by branch and bound: depth first with a stack of its own, a bound from below for the rows that are
left, the best edits so far (cost, then edits' letters), and for each place and state the best way to come there, which
ends worse ways. What blocks give is joined in their order, so no task needs a whole conversation's rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import written
from hotgrid.llm.manifest import numbered

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that are solved together.
BLOCK = 64
SPACE = r"\x20\x09-\x0D"
#: Faults: none, blank, duplicate, truncated.
OK, BLANK, DUPLICATE, CUT = "", "b", "d", "t"
#: By state (nothing yet, after system, after user, after assistant) the initials that may follow and where they lead.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Edits that end a conversation from each state.
ENDS = ("", "II", "I", "")
LEGAL = ("su", "ua", "au")
TABLE = "array<struct<came:int,left:int,cost:long,audit:string>>"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with repeatable damage; nulls of role, text and in the checksum are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    out = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(times).alias("time"))
    return out.drop("time")


def fault() -> Column:
    """A row's own fault: blank or truncated; whether it is a duplicate takes the rows before it."""
    return F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), CUT).otherwise(OK)


def onward(state: int) -> int:
    """The state after a user or assistant row that is put where it may stand."""
    return 3 if state == 2 else 2


def edits(initial: str, wrong: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row."""
    if wrong in (BLANK, DUPLICATE):
        return [("D", DELETE, state)]
    more = TRUNCATED if wrong == CUT else 0
    found = [("D", DELETE, state), ("R", REROLE + more, onward(state))]
    return [*found, ("K", more, FOLLOWS[state][initial])] if initial in FOLLOWS[state] else found


def bounds(rows: list[tuple[str, str]]) -> list[int]:
    """For each place, a cost that the rows from there on have at least.

    Every row costs its cheapest edit. Two rows that cannot follow each other, with none but deleted ones between, cost 3
    more (an insertion or a new role), or 1 if one is truncated, as to delete that one costs 4 in place of 3. Such pairs
    are taken apart from each other.
    """
    n = len(rows)
    out, base, later = [0] * (n + 1), [0] * n, None
    for i in range(n - 1, -1, -1):
        initial, wrong = rows[i]
        more = TRUNCATED if wrong == CUT else 0
        forced, known = wrong in (BLANK, DUPLICATE), initial in ("s", "u", "a")
        base[i] = DELETE if forced else more if known else min(DELETE, REROLE + more)
        out[i] = base[i] + out[i + 1]
        if forced:
            continue
        if known and later is not None and rows[later][0] in ("s", "u", "a") and initial + rows[later][0] not in LEGAL:
            least = 1 if CUT in (wrong, rows[later][1]) else min(INSERT, REROLE)
            out[i] = max(out[i], sum(base[i : later + 1]) + least + out[later + 1])
        later = i
    return out


def repair(rows: list[tuple[str, str]], came: int, left: int, rest: list[int] | None = None) -> tuple[int, str] | None:
    """The cheapest edits (cost, letters) of rows (initial, fault) that lead from the state ``came`` to ``left``; of equal
    cost the least letters. None if there are none. Rows are inserted before rows only.

    A way to a place and state is worse than another for good if it costs more, or as much with greater
    letters: ways to one place have done the same rows, so of equal cost neither's letters begin the other's.
    """
    rest, n = rest or bounds(rows), len(rows)
    best: tuple[int, str] | None = None
    known: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, came, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best and (cost + rest[i], audit) >= best:
            continue
        if state in known[i] and known[i][state] <= (cost, audit):
            continue
        known[i][state] = (cost, audit)
        if i == n:
            best = (cost, audit) if state == left else best
            continue
        ways = [(cost + c + rest[i + 1], letter, i + 1, s, cost + c) for letter, c, s in edits(*rows[i], state)]
        ways.append((cost + INSERT + rest[i], "I", i, onward(state), cost + INSERT))
        stack += [(j, s, c, audit + letter) for _, letter, j, s, c in sorted(ways, reverse=True)]  # the cheapest is popped first
    return best


def solved(rows: list[tuple[str, str]], first: bool) -> list[dict]:
    """Of a block, the best edits for each pair of states; the first block is entered with nothing."""
    rest = bounds(rows)
    found = [(a, b, repair(rows, a, b, rest)) for a in ((0,) if first else range(4)) for b in range(4)]
    return [{"came": a, "left": b, "cost": r[0], "audit": r[1]} for a, b, r in found if r]


class Joined:
    """The best edits of the blocks so far, for each state.

    Letters are kept as a chain of the blocks' own, and compared by their order among the states: all have
    done the same rows and end with one, so none begins another.
    """

    def __init__(self):
        self.ways = {0: (0, 0, None)}

    def add(self, table: list[dict]) -> None:
        found: dict[int, tuple] = {}
        for t in table:
            if t["came"] in self.ways:
                cost, order, chain = self.ways[t["came"]]
                new = (cost + t["cost"], order, t["audit"], (chain, t["audit"]))
                if t["left"] not in found or new[:3] < found[t["left"]][:3]:
                    found[t["left"]] = new
        order = sorted(found, key=lambda s: found[s][1:3])
        self.ways = {s: (found[s][0], order.index(s), found[s][3]) for s in found}

    def end(self) -> tuple[int, list[str]]:
        """The cost, and each block's letters, those of the last with what ends the conversation."""
        cost, _, state = min((c + INSERT * len(ENDS[s]), order, s) for s, (c, order, _) in self.ways.items())
        parts, chain = [], self.ways[state][2]
        while chain:
            chain, part = chain
            parts.append(part)
        parts.reverse()
        parts[-1] += ENDS[state]
        return cost, parts


def _streamed(columns: int, start, add, end, schema: pa.Schema, rows: int = 1024):
    """Runs over sorted batches: ``start(key)`` at a new key, ``add(state, row)`` per row, ``end(key, state)`` gives rows."""

    def flushed(out):
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches):
        key = state = None
        out: list[dict] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                if row[:columns] != key:
                    if key is not None:
                        out += end(key, state)
                    key, state = row[:columns], start(row[:columns])
                add(state, row[columns:])
                if len(out) >= rows:
                    yield flushed(out)
                    out = []
        if key is not None:
            out += end(key, state)
        if out:
            yield flushed(out)

    return run


_TABLE = pa.list_(pa.struct([("came", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_BLOCKS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("ways", _TABLE)])


def _solve_blocks():
    """Rows (tree, block, at, kind, initial, fault), where a row of kind 0 tells that the next is no duplicate."""

    def add(state, row):
        at, kind, initial, wrong = row
        if kind == 0:
            state["fresh"] = at
        else:
            state["rows"].append((initial, wrong if wrong == BLANK or state["fresh"] == at else DUPLICATE))

    def end(key, state):
        rows = state["rows"]
        n = lambda x: sum(w == x for _, w in rows)
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        yield {"tree": key[0], "block": key[1], "blank": n(BLANK), "duplicate": n(DUPLICATE), "truncated": n(CUT), "illegal": illegal, "first": rows[0][0], "last": rows[-1][0], "ways": solved(rows, key[1] == 0)}

    return _streamed(2, lambda key: {"fresh": None, "rows": []}, add, end, _BLOCKS)


_PARTS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())])


def _join_blocks():
    """Blocks in order to each block's letters; the counts and the cost are the conversation's, at its block 0."""

    def add(state, row):
        block, *counts, first, last, ways = row
        for k, n in enumerate(counts):
            state["n"][k] += n
        state["n"][3] += state["last"] is not None and state["last"] + first not in LEGAL
        state["last"] = last
        state["ways"].add(ways)

    def end(key, state):
        cost, parts = state["ways"].end()
        for i, part in enumerate(parts):
            yield {"tree": key[0], "block": i, "audit": part, "cost": 0 if i else cost} | {k: 0 if i else n for k, n in zip(("blank", "duplicate", "truncated", "illegal"), state["n"], strict=True)}

    return _streamed(1, lambda key: {"n": [0, 0, 0, 0], "last": None, "ways": Joined()}, add, end, _PARTS)


class Repaired:
    """The rows that edits make, one after another."""

    def __init__(self):
        self.state, self.letters = 0, iter("")

    def _put(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = onward(self.state)
        return role

    def part(self, audit: str):
        """Rows that the last part still inserts; then ``audit`` is the part that following rows meet."""
        yield from self.rest()
        self.letters = iter(audit)

    def rest(self):
        for _ in self.letters:
            yield self._put(), ""

    def row(self, role: str, text: str):
        for letter in self.letters:
            if letter == "I":
                yield self._put(), ""
                continue
            if letter == "K":
                self.state = FOLLOWS[self.state][role[:1]]
                yield role, text
            elif letter == "R":
                yield self._put(), text
            return


def _hash_rows():
    """Rows (tree, block, kind, at, role, text) after their block's letters, of kind 0, to a digest of the repaired conversation."""

    def say(state, rows):
        for role, text in rows:
            state["hash"].update(f"{state['between']}{role}:{text}".encode())
            state["between"] = "\n"

    def add(state, row):
        _, kind, _, role, text = row
        say(state, state["made"].row(role, text) if kind else state["made"].part(text))

    def end(key, state):
        say(state, state["made"].rest())
        yield {"tree": key[0], "repaired_sha256": state["hash"].hexdigest()}

    schema = pa.schema([("tree", pa.string()), ("repaired_sha256", pa.string())])
    return _streamed(1, lambda key: {"hash": hashlib.sha256(), "between": "", "made": Repaired()}, add, end, schema)


def _solution(rows: DataFrame) -> DataFrame:
    """(tree, block, audit, cost and counts) of numbered rows."""
    keyed = rows.select("tree", "at", "role", F.sha2("text", 256).alias("said"))
    fresh = keyed.groupBy("tree", "role", "said").agg(F.min("at").alias("at")).select("tree", "at", F.lit(0).alias("kind"), F.lit("").alias("initial"), F.lit("").alias("fault"))
    both = rows.select("tree", "at", F.lit(1).alias("kind"), F.substring("role", 1, 1).alias("initial"), fault().alias("fault")).unionByName(fresh)
    both = both.select("tree", F.floor(F.col("at") / BLOCK).alias("block"), "at", "kind", "initial", "fault")
    dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "at", "kind")
    counts = "blank long, duplicate long, truncated long, illegal long"
    blocks = dealt.mapInArrow(_solve_blocks(), f"tree string, block long, {counts}, first string, last string, ways {TABLE}")
    ordered = blocks.repartition("tree").sortWithinPartitions("tree", "block")
    return ordered.mapInArrow(_join_blocks(), f"tree string, block long, audit string, cost long, {counts}")


def _named(rows: DataFrame) -> DataFrame:
    """With ``tree``, the conversation's name; rows without one are a conversation too."""
    return rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


def repaired(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``rows`` has conv_id, turn, role, text; null roles and texts are one space. Rows are taken by turn, null turns first, those
    of equal turns by role and text; repeated rows are duplicates. Rows with a null conv_id are one conversation.
    Conversations of ``originals`` without rows have zeros, empty letters and the hash of nothing, as has one whose rows
    are all deleted its own. An empty table gives no rows; other columns are not read; texts of any length are read whole.

    Rows are dealt and numbered by ranges and solved in blocks of ``BLOCK``. Only letters meet per conversation, and for the
    digest, which has to see a conversation in its order, its rows pass one hash one by one.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = _named(rows).select("tree", F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    at = numbered(plain, ["turn", "role", "text"], dear=False).select("tree", "at", "turn", "role", "text")
    at = written(at, "turns")
    parts = written(_solution(at), "repairs")
    block = F.floor(F.col("at") / BLOCK).alias("block")
    told = parts.select("tree", "block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = at.select("tree", block, F.lit(1).alias("kind"), "at", "role", "text").unionByName(told)
    hashes = both.repartition("tree").sortWithinPartitions("tree", "block", "kind", "at").mapInArrow(_hash_rows(), "tree string, repaired_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit")
    found = parts.groupBy("tree").agg(*sums, audit)
    gaps = at.groupBy("tree").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    every = _named((originals if originals is not None else rows).select("conv_id").distinct())
    out = every.join(found, "tree", "left").join(gaps, "tree", "left").join(hashes, "tree", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """:func:`repaired` of :func:`damaged` conversations, of every original one."""
    return repaired(damaged(conversations), conversations)
