"""The pipeline's rows against its stages' definitions by brute force on small tables."""

import random

import corpus_pipeline
import public_tokenizers
from test_tables import _groups
from test_texts import _base_spans, _contamination

from hotgrid.llm import langid, secrets_scan
from hotgrid.llm.tokens import load


def test_stages_on_the_smallest_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns
    assert seen["language"] >= seen["near_dedup"] >= seen["decontamination"] == seen["secrets"] > 100
    kept = {r.doc_id: r.text for r in before.collect()}
    assert not any(secrets_scan.scan(t) for t in kept.values())
    tok = load(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in kept.values())
    assert total == docs.groupBy().sum("length").first()[0] and {r.doc_id for r in docs.collect()} == set(kept)


def _table():
    rnd = random.Random(11)
    words = {"en": "the house is under water and with thing some other words about people", "de": "das haus ist unter wasser und mit ding einige andere worte von leuten"}
    make = lambda lang, n: " ".join(rnd.choices(words[lang].split(), k=n))
    rows = [(i, make(x, rnd.randint(30, 200)), x) for i, x in enumerate(["en", "de", "en"] * 12)]
    passage = "Which of these seven planets is the one that turns around itself the slowest of all"
    rows += [(100, None, None), (101, "", "en"), (102, "12 34 !!", "en"), (103, rows[3][1], "en"), (104, rows[3][1] + " end", "en"), (3, rows[3][1], "en"), (105, rows[5][1], "de")]
    rows += [(106, make("en", 40) + " " + passage + " " + make("en", 40), "en"), (107, 'key = "qX9vT2Lm8Rz4Wk1P"\npassword=abcdefghijkl9\n' + make("en", 50), None), (108, make("en", 6000), "en")]
    return rows, [(1, passage), (2, None), (3, "short one")]


def test_run_against_brute_force(spark, tmp_path):
    rows, items = _table()
    docs = spark.createDataFrame([(i, t, x, "s", len(t) if t is not None else None) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    labeller = langid.Labeller(langid.fit(docs.where(~langid.held_out())))
    found = [(i, t, *labeller.label(t)[:2]) for i, t, _ in rows]
    kept = [(i, t) for i, t, lang, score in found if lang != "und" and score >= 0.5]
    assert {100, 101, 102}.isdisjoint(i for i, _ in kept) and len(kept) > 35
    unique = sorted(set(kept))
    group = _groups([t for _, t in unique])
    kept = [x for k, x in enumerate(unique) if group[k] == k]
    assert {103, 104, 105}.isdisjoint(i for i, _ in kept)
    known = [(str(i), t) for i, t in items if t]
    kept = [(i, t) for i, t in kept if not _contamination(t, known)[-1]]
    assert 106 not in dict(kept)
    kept = [(i, secrets_scan.redact(t)) for i, t in kept]
    assert not any(_base_spans(t) for _, t in kept) and "abcdefghijkl9" not in dict(kept)[107]
    tok = load(public_tokenizers.path("word_bpe_49k.json"))
    want = {(i, k // 2048, k, min(2048, n - k)) for i, t in kept for n in [len(tok.encode(t, add_special_tokens=False).ids) + 1] for k in range(0, n, 2048)}
    assert set(zip(got.doc_id, got.piece, got.start, got.length, strict=True)) == want and len(got) == len(want)
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= 2048


def test_languages_can_be_chosen(spark, tmp_path):
    rows, _ = _table()
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    both, german = (corpus_pipeline.language(spark, docs, "", languages=x) for x in (None, ("de",)))
    assert {r.lang for r in german.collect()} == {"de"} and 0 < german.count() < both.count() < docs.count()


def test_few_and_many_ids_give_the_same(spark, monkeypatch):
    from hotgrid.llm import common

    df = spark.createDataFrame([(i % 7, i) for i in range(50)] + [(None, 9)], "doc_id long, x long")
    ids = spark.createDataFrame([(2,), (3,), (3,)], "doc_id long")
    few = [sorted(f(df, ids).collect(), key=str) for f in (common.without, common.only)]
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert few == [sorted(f(df, ids).collect(), key=str) for f in (common.without, common.only)]
    assert len(few[0]) + len(few[1]) == 51 and {r.doc_id for r in few[1]} == {2, 3}


def test_empty_table_passes_through(spark, sf, tmp_path):
    for n in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
