"""Language identification (operator 10) of mixed-language texts.

A word's script narrows the languages that it can be in to those that use the script;
among these its hashed character trigrams give a score per language. Viterbi with a
penalty for each switch then labels every word, so that a text falls into spans of one
language each. The table of trigram counts has a fixed size whatever the corpus.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import map_texts

BUCKETS = 1 << 15
#: Labelled rows per language that the model is fitted on at most.
FIT_ROWS = 4_000
#: Languages that the model knows at most: those with the most labelled rows. It bounds what is broadcast.
LANGS = 500
#: What a change of language costs, and the most that one word can speak for a language.
SWITCH, MOST = 14.0, 6.0
#: A language uses a script if this share of its letters is in it.
USES = 0.01
#: A word is a letter and the letters and combining marks after it (fractions, Roman numerals and the like are none).
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_ASCII_WORD = re.compile(r"[A-Za-z]+")
#: Entries that a task's memo of words may hold before it is emptied.
MEMO = 400_000


@functools.lru_cache(4096)
def script_of(char: str) -> str:
    """The script of a letter, as its Unicode name begins."""
    name = unicodedata.name(char, "OTHER")
    first = name.split()[0]
    return "HAN" if first in ("CJK", "IDEOGRAPHIC") else "LATIN" if first in ("FEMININE", "MASCULINE", "MICRO") else first


def grams(word: str) -> tuple[int, ...]:
    w = f"^{word}$"
    return tuple(zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(max(1, len(w) - 2)))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: languages x buckets: log probability of a trigram
    table: np.ndarray
    #: script -> for each language 0 if it uses it, else -inf
    scripts: dict[str, np.ndarray]
    prior: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Of lower-case words, for each language; the best one's is 0, none is below -MOST."""
        each = [grams(w) for w in words]
        starts = np.cumsum([0, *map(len, each[:-1])])
        s = np.add.reduceat(self.table[:, np.fromiter(chain.from_iterable(each), np.int64)], starts, axis=1).T
        no = np.zeros(len(self.langs), np.float32)
        s = s + np.array([self.scripts.get(script_of(w[0]), no) for w in words], np.float32)
        return np.maximum(s - s.max(axis=1, keepdims=True), -MOST)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def lowered(text: str) -> str:
    """The text in lower case if that keeps every character's place, else as it is."""
    low = text.lower()
    return low if len(low) == len(text) else text  # a lower-case form is never shorter


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text."""
    if not text:
        return []
    low = lowered(text)
    found = _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)
    return [w.lower() for w in found] if low is text else found


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, langs: int = LANGS) -> Model:
    """Counts trigrams and scripts of at most about ``rows`` labelled rows a language.

    The rows are chosen by a hash of their id, the same at every partitioning. Rows with a
    null text or language are not used. Without any row the model has no language. Of more than
    ``langs`` values (dirty labels) those with the most rows are learned.
    """
    rowsin = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    most = rowsin.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(langs)
    have = {r[0]: r[1] for r in most.collect()}
    if not have:
        return Model((), np.zeros((0, BUCKETS)), {}, np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, min(1.0, rows / n))])
    chosen = rowsin.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000)

    def count(batches):
        found, letters = {}, Counter()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                into = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for w, n in Counter(words_of(text)).items():
                    np.add.at(into, list(grams(w)), n)
                    letters[lang, script_of(w[0])] += n * len(w)
        rows = [(lang, str(i), int(c[i])) for lang, c in found.items() for i in np.flatnonzero(c)] + [(k, "script " + s, n) for (k, s), n in letters.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "k", "n"])

    langs = tuple(sorted(have))
    table, scripts = np.zeros((len(langs), BUCKETS)), {}
    counted = chosen.select(text_col, lang_col).mapInArrow(count, "lang string, k string, n long")
    for lang, k, n in counted.groupBy("lang", "k").agg(F.sum("n")).collect():
        at = langs.index(lang)
        if k.startswith("script "):
            scripts.setdefault(k[7:], np.zeros(len(langs)))[at] = n
        else:
            table[at, int(k)] = n
    letters = np.maximum(sum(scripts.values(), np.zeros(len(langs))), 1)
    masks = {s: np.where(n >= USES * letters, 0, -np.inf) for s, n in scripts.items()}
    masks = {s: m for s, m in masks.items() if np.isfinite(m).any()}
    total = table.sum(axis=1, keepdims=True)
    logs = np.log((table + 0.5) / (total + 0.5 * BUCKETS))
    n = np.array([have[k] for k in langs], float)
    return Model(langs, logs.astype(np.float32), masks, np.log(n / n.sum()))


class Labeller:
    """Labels the words of texts; scores of words are remembered between texts."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch, self.at, self.rows = model, switch, {}, np.zeros((1024, max(1, len(model.langs))), np.float32)

    def _scores(self, words: list[str]) -> np.ndarray:
        at = self.at
        try:
            return self.rows[[at[w] for w in words]]
        except KeyError:
            pass
        if len(at) > MEMO:
            at.clear()
        new = list(set(words).difference(at))
        while len(at) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(at) : len(at) + len(new)] = self.model.scores(new)
        at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
        return self.rows[[at[w] for w in words]]

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word: Viterbi over n x languages scores.

        Where no stretch of words gains as much as one switch costs by leaving the language
        that is best over all, and none at the start and at the end together (between which a
        chain of others may lie, with a switch for each), that language is the whole best
        path, and no table is needed.
        """
        prior = self.model.prior * 1e-3
        best = int((s.sum(axis=0, dtype=np.float64) + prior).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
        before = np.vstack([np.zeros(s.shape[1]), gain])[:-1]
        low = np.minimum.accumulate(before, axis=0)
        ends = (gain + prior - prior[best]).max(initial=0) + (gain[-1:] - before).max(initial=0)
        if ends <= self.switch and (gain - low).max(initial=0) <= self.switch:
            return np.full(len(s), best)
        rows, back, cost = s.tolist(), [], self.switch
        v = [float(x) for x in prior]
        for row in rows:
            top = max(range(len(v)), key=v.__getitem__)
            enter = v[top] - cost
            back.append([k if x >= enter else top for k, x in enumerate(v)])
            v = [(x if x >= enter else enter) + y for x, y in zip(v, row, strict=True)]
        out, k = np.empty(len(rows), int), max(range(len(v)), key=v.__getitem__)
        for i in range(len(rows) - 1, -1, -1):
            out[i] = k
            k = back[i][k]
        return out

    def label(self, text: str | None, spans: bool = False) -> tuple[str, float, list[dict]]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0, []
        s = self._scores(words)
        path = self.path(s)
        best, share = int(path[0]), 1.0
        if (path != best).any():
            letters = np.bincount(path, weights=np.fromiter(map(len, words), np.float64, len(words)), minlength=len(self.model.langs))
            best = int(letters.argmax())
            share = float(letters[best] / letters.sum())
        total = s.sum(axis=0, dtype=np.float64).tolist()
        margin = min((total[best] - x for k, x in enumerate(total) if k != best), default=50.0)
        score = share / (1 + math.exp(-max(-50.0, min(50.0, margin))))
        return self.model.langs[best], min(1.0, max(0.0, score)), self._spans(text, path) if spans else []

    def _spans(self, text: str, path: np.ndarray) -> list[dict]:
        """Stretches of words of one language: a change of language in the path ends one."""
        low = lowered(text)
        found = _ASCII_WORD.finditer(low) if low.isascii() else _WORD.finditer(low)
        ends = set((np.flatnonzero(np.diff(path)) + 1).tolist())
        out: list[dict] = []
        if not ends:  # one language: only the first and the last letter's places are needed
            last = len(text)
            while not unicodedata.category(text[last - 1]).startswith("L"):
                last -= 1
            while last < len(text) and unicodedata.category(text[last]).startswith("M"):
                last += 1
            return [{"lang": self.model.langs[path[0]], "start": next(found).start(), "end": last}]
        for i, m in enumerate(found):
            if not i or i in ends:
                out.append({"lang": self.model.langs[path[i]], "start": m.start(), "end": 0})
            out[-1]["end"] = m.end()
        return out


def identify(df: DataFrame, model: Model, spans: bool = False, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score) and, if asked for, the spans of one language each; no shuffle.

    lang_pred is the language with the most letters; score its share of the letters, lowered
    where a rival is close over the whole text. Null texts and texts without a letter are
    ``und`` with score 0 and no spans, as are all without a learned language. A text of any length
    is read whole. Spans are code points of the text, ends exclusive. Ties go to the first language by name. Repeated rows
    give repeated rows, an empty table none; other columns are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
    if spans:
        fields.append(("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))

    def start():
        labeller = Labeller(sent.value, switch)

        def f(ids, texts):
            got = [labeller.label(t, spans) for t in texts]
            return {"doc_id": ids, "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "spans": [x[2] for x in got]}

        return f

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:long,end:long>>" * spans
    return map_texts(df, start, pa.schema(fields), schema, id_col, text_col)
