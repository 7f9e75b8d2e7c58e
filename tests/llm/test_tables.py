"""Operators that join, group or write: round trips, brute force and edge cases."""

import hashlib
import html
import random
import re
import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hotgrid.llm import common, neardup, packing, warc, wrappers

PAGES = "page_id long, url string, html string, text string, host string"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


ARTICLE = "<html><body><nav><a href=x>Menu</a></nav><div class=ad>Buy</div><article><h1>T &amp; U</h1><p>one\n two<br>three<p>four <b>five</b></article><footer>foot</footer><script>var a='</p>'</script>"


def test_articles_without_surroundings(spark):
    rows = [(1, "http://a.org/1", ARTICLE), (2, "http://a.org/2", None), (3, None, ""), (4, "http://a.org/3", ARTICLE.replace("four", "4")), (4, "http://a.org/3", ARTICLE), (5, "//b", "plain <b>text"), (6, "http://c.org", "<p>x<div class='comment-list'>no</div><form>no</form><li>y<li>z<" + "b" * 5000), (7, "http://d.org", "<div>" * 3000 + "deep")]
    got = wrappers.extract_text(_pages(spark, rows)).orderBy("page_id").collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == "T & U\none two three\nfour five" and texts[2] == texts[3] == ""
    assert texts[5] == "plain text" and texts[6] == "x\ny\nz" and texts[7] == "deep"
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrappers.extract_text(_pages(spark, rows).limit(0)).count() == 0


def test_joined_wrappers_give_the_same(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    one, two = (wrappers.extract_text(pages, broadcast_bytes=b).orderBy("page_id").collect() for b in (10**9, -1))
    assert one == two
    for r, p in zip(one, pages.orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)


def test_mismatches_become_optional_and_repeated():
    one, two = (wrappers.infer(wrappers.tree(h)) for h in ("<ul><li>a</ul><p>x</p>", "<ul><li>b<li>c</ul><h2>new</h2><p>x</p>"))
    units = wrappers.merge(one, two)[2]
    assert [wrappers.name(u) for u in units] == ["ul", "h2", "p"]
    assert units[1][3] == 1 and units[0][2][0][4] == 1 and units[0][2][0][2][0][1] is None and units[2][2][0][1] is not None
    group = wrappers.infer(wrappers.tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))[2][0][2]
    assert [wrappers.name(u) for u in group] == ["(dt dd)"]


def test_boilerplate_without_an_article(spark):
    rows = [(i, "http://h.org/x", f"<h4>same everywhere</h4><div>text {i}</div>") for i in range(4)]
    assert {r.text for r in wrappers.extract_text(_pages(spark, rows)).collect()} == {f"text {i}" for i in range(4)}


def test_each_text_meets_its_own_slot(spark):
    rows = [(i, "http://h.org/x", f"<div>By <b>Ann</b> long text {i}<br>and more {i}</div>") for i in range(4)]
    assert {r.text for r in wrappers.extract_text(_pages(spark, rows)).collect()} == {f"long text {i} and more {i}" for i in range(4)}


def test_boilerplate_inside_articles(spark):
    pages = [f"<article><h1>T {i}</h1><p>body {i}</p><div class=box>Read this too</div>{'<h5>Sale</h5>' * (i % 2)}</article>" for i in range(8)]
    rows = [(i, "http://h.org/x", h) for i, h in enumerate(pages)] + [(10 + i, "http://copies.org/x", pages[1]) for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extract_text(_pages(spark, rows)).collect()}
    assert all(got[i] == f"T {i}\nbody {i}" for i in range(8))
    assert all(got[10 + i] == "T 1\nbody 1\nRead this too\nSale" for i in range(5))


def test_deep_elements_are_whole(spark):
    deep = lambda x: "<div>" * 3000 + x + "</div>" * 3000
    rows = [(i, "http://h.org/x", f"<div id=page><article>{deep(f'a {i}<nav>menu</nav><p>b {i}</p><h6>Same</h6>')}<p>rest</p></article></div><p>off</p>") for i in range(2)]
    rows += [(10 + i, "http://g.org/x", f"<div id=page><article>{deep(f'a {i}<h6>Same</h6>')}<p>rest {i}</p></article></div><p>off</p>") for i in range(4)]
    rows += [(20, "http://f.org/x", "<i>" * 50_000 + "x" + "</b>" * 50_000 + "</i>" * 50_000 + "y")]
    got = {r.page_id: r.text for r in wrappers.extract_text(_pages(spark, rows)).collect()}
    assert all(got[i] == f"a {i}\nb {i}\nSame\nrest" for i in range(2))
    assert all(got[10 + i] == f"a {i}\nrest {i}" for i in range(4))
    assert got[20] == "xy"


def test_the_wrapper_decides(spark):
    """Pages without article, main or telling names: a wrapper that knows nothing gives another, wrong text."""
    page = "<header>Site</header><div class=q7><span>Home</span><span>About us</span></div><div class=z{k}><h2>Title {i}</h2><p>Body of {i} &amp; more</p>{extra}<p>All rights reserved</p></div><div class=q9>Call us now</div>"
    rows = [(i, "http://h.org/x", page.format(i=i, k=i % 2, extra="<p>Second of {}</p>".format(i) * (i % 3))) for i in range(12)]
    got = {r.page_id: r.text for r in wrappers.extract_text(_pages(spark, rows)).collect()}
    assert got == {i: "\n".join([f"Title {i}", f"Body of {i} & more", *[f"Second of {i}"] * (i % 3)]) for i in range(12)}
    dummy = wrappers._dump(["e", "html", [], 0, 0])
    assert all("About us" in wrappers.extract(h, dummy) and "All rights reserved" in wrappers.extract(h, dummy) for _, _, h in rows)


@pytest.mark.parametrize("page,text", [
    ("<header>SITE</header><div>art</div>", "art"), ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
    ("<p title=it's>hello</p><p class=\"a>b\">you</p>", "hello\nyou"), ("<p a=\"x>still text", "still text"),
    ("<p class=related-work>Related work</p><div id=search-trees>b-trees</div><div class=share-price>12</div>", "Related work\nb-trees\n12"),
    ("<div class=share-buttons>s</div><div id=reader-comments>c</div><p class=ad>a</p><div class='related posts'>r</div><div class=commentList>l</div><section class=box>t</section>", "t"),
])
def test_markup_and_names(page, text):
    assert wrappers.extract(page, wrappers._dump(["e", "html", [], 0, 0])) == text


@pytest.mark.parametrize("opened", ["<div class='page has-sidebar'>", "<div class='entry no-comments'>", "<div class='post comments-open'>", "<section class=ad-hoc-analysis>", "<div class=layout-fixed-footer>", "<div id=main-with-sidebar>", "<article><div class='entry has-sidebar'>"])
def test_states_of_a_page_tell_nothing_of_an_element(opened):
    dummy = wrappers._dump(["e", "html", [], 0, 0])
    page = opened + "<p>the text</p><div class=reader-comments>c</div><div class=cookie-law-info>k</div><div class=ad-slot>a</div><div class=site-footer>f</div></div>"
    assert wrappers.extract(page, dummy) == "the text"


def _units(units):
    return sum(1 + (_units(u[1]) if u[0] == "g" else _units(u[2]) if u[0] == "e" else 0) for u in units)


def test_wrappers_stay_short(spark):
    """Pages of ordinary blocks in any order: the wrapper grows with their names, not with the pages."""
    rnd, sizes, found = random.Random(2), {}, None
    tags = ["p", "h2", "ul", "figure", "pre", "table", "blockquote", "dl", "h3", "div"]
    page = lambda i: "<h1>Same head</h1>" + "".join(f"<{t}>{i} {k}</{t}>" for k, t in enumerate(rnd.choices(tags, k=25))) + "<h6>Same end</h6>"
    pages = [page(i) for i in range(2000)]
    for i, h in enumerate(pages):
        own = wrappers.infer(wrappers.tree(h))
        found = wrappers.merge(found, own) if found else own
        sizes[i + 1] = _units(found[2])
    assert sizes[2000] <= sizes[200] * 1.1 and sizes[2000] < 2 * wrappers.WIDE
    assert not wrappers.is_bag(wrappers.merge(*map(wrappers.infer, map(wrappers.tree, ("<p>a<h2>b", "<p>c<h3>d"))))[2])
    # what all pages share still goes, and nothing else does
    rows = [(i, "http://h.org/x", h) for i, h in enumerate(pages[:300])]
    got = {r.page_id: r.text for r in wrappers.extract_text(_pages(spark, rows)).collect()}
    dummy = wrappers._dump(["e", "html", [], 0, 0])
    assert got == {i: wrappers.extract(h, dummy).removeprefix("Same head\n").removesuffix("\nSame end") for i, _, h in rows}


def test_archives_round_trip(spark):
    long = "é" * 600 + "WARC/1.1\r\n\r\n"
    rows = [(1, "http://a", long), (5, "http://b", long), (3, "http://c\r\nX: y", long), (4, None, None), (6, "u", "short"), (7, "u", "short")]
    rows += [(10 + i, "http://hot", "z" * 2000) for i in range(50)]
    got = {r.page_id: r for r in warc.digest_columns(warc.round_trip(_pages(spark, rows))).collect()}
    last = {}
    for i, _, h in rows:
        last[h] = max(i, last.get(h, i))
    assert len(got) == len(rows)
    for i, _, h in rows:
        body = (h or "").encode()
        ref = last[h] if len(body) >= 1000 and last[h] != i else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if ref else "response", ref)
    assert warc.round_trip(_pages(spark, rows).limit(0)).count() == 0
    full = warc.round_trip(_pages(spark, rows[:2]), payloads=True).where("response.type = 'response'").first()
    assert full.response.payload == long and full.request.record_id and full.metadata.payload.startswith("pageId: 5")


@pytest.mark.parametrize("few", [10**6, 0])
def test_no_capture_is_lost(spark, few, tmp_path):
    """Repeated and null ids, equal payloads under them, and a page of 10 MB that looks like an archive."""
    hot, huge = "h" * 1500, "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 300_000
    rows = [(7, "u", hot), (7, "u", hot), (7, "v", "other"), (None, "n", hot), (None, None, None), (3, "w", hot), (8, "x", huge), (9, "y", huge), (9, "y", huge)]
    pages = _pages(spark, rows).select("page_id", "url", "html")
    marked = warc.mark_revisits(pages, broadcast_rows=few)
    warc.records(marked).write.option("lineSep", warc.CRLF).option("compression", "gzip").text(f"{tmp_path}/w")
    back = warc.assemble(warc.read_records(spark, f"{tmp_path}/w"))
    got = sorted(map(tuple, warc.digest_columns(back).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    want = [(7, 1500, "response", None)] * 2 + [(7, 5, "response", None), (None, 1500, "revisit", 7), (None, 0, "response", None), (3, 1500, "revisit", 7), (8, len(huge), "revisit", 9)] + [(9, len(huge), "response", None)] * 2
    assert got == sorted(want, key=str)
    assert {r[0] for r in back.where("response.type = 'response' and response.payload_bytes > 9000").select("response.payload").collect()} == {huge}
    assert back.where("request is null or metadata is null or response is null").count() == 0


def test_transactions_with_missing_records(spark):
    rec = spark.createDataFrame([("response", "r1", None), ("request", "q1", "r1"), ("metadata", "m2", "r2"), ("metadata", "m3", None)], "type string, record_id string, concurrent_to string")
    for c in ("refers_to", "url", "digest", "payload"):
        rec = rec.withColumn(c, F.lit(None).cast("string"))
    got = {r.capture: r for r in warc.assemble(rec.withColumn("payload_bytes", F.lit(0).cast("long"))).collect()}
    assert set(got) == {"r1", "r2", "m3"} and got["r1"].request.record_id == "q1" and got["r2"].response is None


def _bag(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        k = tuple(w[i : i + 5])
        out[k] = out.get(k, 0) + 1
    return out


def _similar(a, b):
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def _groups(texts, least=0.8):
    bags, parent = [_bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if _similar(bags[i], bags[j]) >= least or (not bags[i] and texts[i] == texts[j] and (texts[i] or "").strip()):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def _corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "!!!", "!!!", "two words", "Two, words", "x " * 3000]
    base = [rnd.choice(vocab) for _ in range(150)]
    for _ in range(60):  # a large group of near copies around one text, some of them close to others only
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(20):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 120))]
        texts += [" ".join(w), " ".join(w[: max(5, int(len(w) * rnd.uniform(0.7, 1)))])]
    line = "all rights reserved by the same owner of this line "
    texts += [line * 30 + " ".join(rnd.choices(vocab, k=20)) for _ in range(20)]
    return texts


def test_groups_against_brute_force(documents):
    texts = _corpus()
    got = neardup.near_duplicates(documents(texts)).orderBy("doc_id").collect()
    assert [r.group_id for r in got] == _groups(texts)
    assert got[3].class_id == got[4].class_id == 3 and got[5].class_id == got[6].class_id == 5
    assert neardup.near_duplicates(documents(texts).limit(0)).count() == 0


def test_repeated_rows_and_blocks(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(neardup, "VISIT_SHINGLES", 700)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = _corpus(2)
    docs = documents(texts)
    want = _groups(texts)
    nameless = docs.where("doc_id in (3, 40)").withColumn("doc_id", F.lit(None).cast("long"))
    got = neardup.near_duplicates(docs.unionByName(docs.where("doc_id < 12")).unionByName(nameless)).collect()
    assert sorted((r.doc_id, r.group_id) for r in got if r.doc_id is not None) == sorted([*enumerate(want), *list(enumerate(want))[:12]])
    assert sorted(r.group_id for r in got if r.doc_id is None) == sorted([want[3], want[40]])


def test_recall_of_similar_pairs(spark):
    """All pairs of similarity 0.8 and more of a test table, by an index from shingles to texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    bags, index = {i: _bag(t) for i, t in texts.items()}, {}
    for i, bag in bags.items():
        for k in bag:
            index.setdefault(k, []).append(i)
    pairs = {(a, b) for ids in index.values() for a, b in combinations(sorted(set(ids)), 2)}
    alike = [(a, b) for a, b in pairs if _similar(bags[a], bags[b]) >= 0.8]
    group = {r.doc_id: r.group_id for r in neardup.near_duplicates(docs).collect()}
    assert len(alike) > 50 and sum(group[a] == group[b] for a, b in alike) >= 0.99 * len(alike)


def test_signatures_are_unbiased_for_weights():
    rng, errors = np.random.default_rng(5), []
    for _ in range(30):
        items = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        a = rng.integers(0, 6, len(items))
        b = np.where(rng.random(len(items)) < 0.7, a, rng.integers(0, 9, len(items)))
        bags = [(items[x > 0], x[x > 0]) for x in (a, b)]
        doc = np.repeat([0, 1], [len(x) for x, _ in bags])
        sig = neardup.signatures(doc, np.concatenate([x for x, _ in bags]), np.concatenate([c for _, c in bags]).astype(float), 2, k=1000)
        errors.append((sig[0] == sig[1]).mean() - neardup.jaccard(*bags))
    assert abs(np.mean(errors)) < 0.01


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.id: r.group for r in neardup.components(links).collect()}
    assert all(got.get(i, 0) == 0 for i in range(41)) and got[102] == got[101] == 100


@pytest.mark.parametrize("part", [packing.PART, 40])
def test_packing_is_whole_and_tight(documents, part):
    rnd = random.Random(7)
    texts = [None, "", "word " * 9000, *["a b c " * rnd.randint(1, 300) for _ in range(300)], "x", "x"]
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(documents(texts), path)
    got = packing.pack(cut, part_rows=part).toPandas()
    from hotgrid.llm.tokens import load

    tok = load(path)
    for i, t in enumerate(texts):
        rows = got[got.doc_id == i].sort_values("piece")
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert rows.length.sum() == len(ids) and list(rows.start) == list(range(0, len(ids), 2048))
        assert list(rows.ids_crc32) == [zlib.crc32(struct.pack(f"<{len(c)}I", *c)) for k in range(0, len(ids), 2048) if (c := ids[k : k + 2048])]
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= 2048
    bound = packing.lower_bound(got.length.to_numpy())
    assert bound <= got.sequence_id.nunique() <= bound * 1.1 + 1
    assert packing.pack(cut.limit(0)).count() == 0


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, fill = packing.best_fit_decreasing(x, 100)
        assert fill.max() <= 100 and packing.lower_bound(x, 100) <= len(fill) and fill.sum() == x.sum()
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.array([34] * 6), 100) == 3
