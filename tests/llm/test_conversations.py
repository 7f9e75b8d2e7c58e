"""Repaired conversations against exhaustive search and a plain walk."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from hotgrid.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string, tree string, at long, block long, audit string, size long"
SPACE = "[^\x20\x09-\x0d]"


def damage(rows):
    s = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        k, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = re.findall(SPACE, text)
        out.append("b" if not found else "d" if (role, text) in seen else "" if found[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """Least (cost, letters) by a search of cheapest ways first, over (row, roles so far as a state of a regular expression)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, tail = heapq.heappop(heap)  # tail: what the roles so far end with
        if i == len(rows) and tail in ("", "a"):
            return cost, audit
        if (i, tail) in done:
            continue
        done.add((i, tail))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        heapq.heappush(heap, (cost + 3, audit + "I", i, may[-1]))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, tail))
            if wrong[i] not in ("b", "d"):
                more = 3 if wrong[i] == "t" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, may[-1]))
                if rows[i][0][:1] in may and rows[i][0]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, rows[i][0][0]))


def brute(rows):
    """The result of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said, turns = [r[1:] for r in rows], {r[0] for r in rows if r[0] is not None}
    wrong = faults(said)
    cost, audit = cheapest(said, wrong)
    out, at, last = [], 0, ""
    for letter in audit:
        put = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((put, ""))
        else:
            if letter != "D":
                out.append((said[at][0] if letter == "K" else put, said[at][1]))
            at += 1
        last = out[-1][0][0] if out else ""
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    first = [r[:1] for r, _ in said]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[wrong.count(k) for k in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, 2, "K", 3) for r in rows], ROWS)
    got = {r[0]: tuple(r)[1:] for r in C.repaired_digests(df).select(COLUMNS).collect()}
    by = {r[0]: [] for r in rows}
    for conv, *rest in damage(rows):
        by[conv].append(tuple(rest))
    assert got == {k: brute(v) for k, v in by.items()}


TEXTS = ["Good.", "Well!  \n", "no end", "", " \t", "Good.", "x?", "é. y", "Long. " * 2000]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", "Ursa"]


@pytest.mark.parametrize("n", [4, 9, 30])
@pytest.mark.parametrize("roles", [3, 5, 8])
def test_branch_and_bound_is_exact(n, roles):
    rnd = random.Random(n * roles)
    for _ in range(60):
        rows = [(rnd.choice(ROLES[:roles])[:1], rnd.choice("btd" + " " * 5).strip()) for _ in range(rnd.randrange(n + 1))]
        full = [(r, "") for r, _ in rows]
        want = cheapest(full, [w for _, w in rows])
        joined = C.Joined()
        for i in range(0, len(rows), 5):
            joined.add(C.solved(rows[i : i + 5], i == 0))
        if rows:
            cost, parts = joined.end()
            assert (cost, "".join(parts)) == want
            one = C.Joined()
            one.add(C.solved(rows, True))
            assert one.end()[0] == want[0] and one.end()[1] == [want[1]]
        assert C.bounds(rows)[0] <= want[0]


def test_conversations_of_every_kind(spark):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(ROLES[: rnd.choice([2, 4, 5, 8])]), rnd.choice(TEXTS)) for c in range(60) for t in range(rnd.randrange(1, 14))]
    rows += [(None, None, None, None), (None, 3, "user", "Yes."), (None, None, "user", "No."), (-5, None, "user", "A."), (-5, 10, "assistant", "B."), (-5, 10, "assistant", "B.")]
    check(spark, rows)


def test_a_conversation_of_many_blocks(spark):
    rnd = random.Random(4)
    rows = [(1, t + (t > 300) * 7, rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else ("user", "assistant")[t % 2], rnd.choice([f"Say {t}.", f"cut {t}", "Again."])) for t in range(700)]
    check(spark, rows + [(2, t, "user", "") for t in range(200)])


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "Hi.")])
    df = spark.createDataFrame([], ROWS)
    assert C.repaired_digests(df).collect() == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    check(spark, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
