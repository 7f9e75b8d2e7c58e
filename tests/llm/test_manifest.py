"""The Merkle manifest against a tree that is made in memory."""

import hashlib
import random
import zlib

import pytest

from hotgrid.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, size long, digest string, path string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _path(levels, i):
    for level in levels[:-1]:
        at = i // 16 * 16
        yield level[at:i], level[i + 1 : at + 16]
        i //= 16


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(((r[0] is not None, r[0] or 0), _leaf(r, r[1]), r))
    keys = sorted(by)
    trees = {k: _levels([x[1] for x in sorted(by[k], key=lambda x: x[:2])]) for k in keys}
    top = _levels([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, (_, leaf, r) in enumerate(sorted(by[k], key=lambda x: x[:2])):
            path = [*_path(trees[k], i), *_path(top, n)]
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            acc = _leaf(r, r[1].encode().lower().decode()) if change else leaf
            for left, right in path:
                acc = _h(*left, acc, *right)
            root = top[-1][0]
            out.append((r[0], leaf, trees[k][-1][0], root, _h(*[s for a, b in path for s in a + b]), acc, acc == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, 2, "d", "p") for r in rows], DOCS)
    got = [tuple(r) for r in manifest.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def _row(i, source, text="Some Text", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4097])
def test_trees_of_every_height(spark, n):
    got = check(spark, [_row(i, "s", f"Text {i}") for i in range(n)])
    assert len(got) == n and any(not r[-1] for r in got) == any(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(n))


def test_many_sources_nulls_ties_and_repeated_rows(spark):
    rnd = random.Random(3)
    rows = [_row(rnd.randrange(300), rnd.choice([None, "", "é", "Z", "a", *map(str, range(290))]), rnd.choice([None, "", "É A b", "low", "X" * 200_000])) for _ in range(700)]
    rows += [_row(None, None, None, None)] * 3 + [_row(5, "a")] * 40 + [_row(5, "a", "other")] * 3
    check(spark, rows)


def test_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_only_every_second_level_is_stored(spark):
    df = spark.createDataFrame([(*_row(i, "s"), "t", 1, 2, "d", "p") for i in range(300)], DOCS)
    m = manifest.build(df)
    sizes = [b.selectExpr("sum(size(nodes)) n").first()["n"] for b in m.sources]
    assert sizes == [300, 2, 1] and [b.selectExpr("sum(size(nodes)) n").first()["n"] for b in m.top] == [1]
