"""SimHash by the Gray-order index against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from hotgrid.llm import graysim


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(values, most=3):
    """The least value that each distinct value reaches."""
    values, label = sorted(set(values)), {}
    for v in values:
        if v in label:
            continue
        label[v], stack = v, [v]
        while stack:
            x = stack.pop()
            for y in values:
                if y not in label and (x ^ y).bit_count() <= most:
                    label[y] = v
                    stack.append(y)
    return label


def clustered(rnd, n, centres, flips=4):
    base = [rnd.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rnd.choice(base)
        for _ in range(rnd.randrange(flips + 1)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprints():
    rnd = random.Random(1)
    texts = [None, "", " \t\n\x0b\f\r", "One", "one  TWO", "A b c d", "É é\x1cx y z", " ".join(rnd.choice("abcdefg") for _ in range(500)), "x " * 70_001]
    assert [graysim.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_trees_find_every_link(seed):
    rnd = random.Random(seed)
    fps = np.array(clustered(rnd, rnd.choice([2, 9, 70, 600]), rnd.choice([1, 3, 40])), np.uint64)
    bucket = np.array([rnd.randrange(3) for _ in fps])
    trees = graysim.Trees(fps, bucket)
    own = {int(f): int(b) for f, b in zip(fps, bucket, strict=True)}
    q, other = trees.links(np.arange(len(fps)), 3)
    got = sorted(tuple(sorted((int(trees.fps[a]), int(trees.fps[b])))) for a, b in zip(q, other, strict=True))
    want = sorted((a, b) for a in own for b in own if a < b and own[a] == own[b] and (a ^ b).bit_count() <= 3)
    assert got == want


def test_masks_cover_every_difference():
    rnd = random.Random(5)
    for _ in range(500):
        diff = sum({1 << rnd.randrange(64) for _ in range(3)})
        hit = [m for m in graysim.masks() if not m & diff]
        assert hit and all(any(not c & diff for c in graysim.masks(m)) for m in hit)
    assert max(64 - c.bit_count() for m in graysim.masks() for c in graysim.masks(m)) == 30


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_connect_what_brute_force_connects(spark, bucket):
    fps = clustered(random.Random(bucket), 700, 12)
    df = spark.createDataFrame([(graysim._signed(f),) for f in fps], "fp long")
    links = graysim.links(df, bucket=bucket)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links.collect():
        x, y = sorted((root(a % 2**64), root(b % 2**64)))
        parent[y] = x
    assert {f: root(f) for f in fps} == brute(fps)


def test_documents(spark, documents):
    rnd = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    texts = [None, "", " \n", "One", "one", "one two", "ONE  TWO"]
    for _ in range(25):
        own = [rnd.choice(words) for _ in range(rnd.choice([5, 60, 400]))]
        texts += [" ".join(own), " ".join(own).upper(), " ".join(own[:-1] + ["z"]), " ".join(own + own[:3])]
    texts += [texts[20]] * 60 + ["x " * 100_000]
    df = documents(texts)
    df = df.unionByName(df.where("doc_id < 9")).unionByName(df.where("doc_id in (3, 30)").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "score", "id", "items"))
    got = graysim.near_duplicates(df).collect()
    prints = [slow_fingerprint(t) for t in texts]
    label, first = brute(prints), {}
    for i, p in enumerate(prints):
        first.setdefault(label[p], i)
    assert len(got) == len(texts) + 9 + 2
    for r in got:
        i = r.doc_id if r.doc_id is not None else next(k for k in (3, 30) if f"{prints[k]:016x}" == r.fingerprint)
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", first[label[prints[i]]])
    assert graysim.near_duplicates(df.limit(0)).collect() == []
