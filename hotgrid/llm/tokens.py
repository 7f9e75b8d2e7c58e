"""Token counts (operator 7) and token ids, from vocabulary files of public tokenizers.

Whole-token shortcut: a vocabulary string is *proven whole* if the pre-tokenizer
leaves it in one piece and the library encodes it, alone, as one token. Merges work
inside a pre-token only, so every pre-token of a text that equals a proven string is
one token wherever it stands, and no merge has to be run for it. Only the other
pre-tokens go to the library's merges, each distinct one once per task's memo.
"""

from __future__ import annotations

import functools
import os
import zlib
from struct import pack
from unicodedata import normalize, ucd_3_2_0

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hotgrid.llm.common import map_texts

#: White space as the tokenizer libraries' regular expressions understand ``\s``.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-token patterns of the two public vocabularies (fixed by the vocabulary files).
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
WORD_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+"
#: Entries that a task's memo of merged pre-tokens may hold before it is emptied.
MEMO = 600_000


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def _special(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


@functools.lru_cache(4)
def _byte_decoder() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(1)
def _stand_ins() -> dict[int, str]:
    return {b: c for c, b in _byte_decoder().items()}


def merge(tok, pre: str) -> list:
    """The tokens of one pre-token: the model's merges alone, without the library's pipeline."""
    return tok.model.tokenize(pre.encode().decode("latin-1").translate(_stand_ins()))


@functools.lru_cache(4)
def whole_tokens(path: str, pattern: str = BYTE_LEVEL) -> frozenset[str]:
    """Vocabulary strings that, as a pre-token, are proven to be exactly one token."""
    tok, split, byte, strings = load(path), regex.compile(pattern), _byte_decoder(), []
    for piece in tok.get_vocab(with_added_tokens=False):
        try:
            s = bytes(byte[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character is never a pre-token
        if split.fullmatch(s) and split.findall(s) == [s]:
            strings.append(s)
    return frozenset(s for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens of texts; ``merged`` tells how many pre-tokens needed merges."""

    def __init__(self, path: str, pattern: str = BYTE_LEVEL, whole: frozenset[str] | None = None):
        self.tok, self.findall = load(path), regex.compile(pattern).findall
        self.whole = dict.fromkeys(whole_tokens(path, pattern) if whole is None else whole, 1)
        self.memo, self.merged = dict(self.whole), 0
        self.special = regex.compile("|".join(map(regex.escape, _special(path))) or r"(?!)")

    def _part(self, text: str) -> int:
        pre = self.findall(text)
        try:
            return sum(map(self.memo.__getitem__, pre))
        except KeyError:
            pass
        if len(self.memo) > MEMO + len(self.whole):
            self.memo = dict(self.whole)
        rest = list(set(pre).difference(self.memo))
        self.merged += len(rest)
        for s in rest:
            self.memo[s] = len(merge(self.tok, s))
        return sum(map(self.memo.__getitem__, pre))

    def count(self, text: str) -> int:
        """As many tokens as the library gives: a special string in the text is one."""
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._part(p) for p in parts if p)


def count_tokens(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; no shuffle.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and ids are counted
    row by row; other columns of ``df`` are not read. An empty table gives no rows.

    The proof is made once, before the job, and what it proved is broadcast: at most the
    vocabulary's strings, whatever the corpus.
    """
    proven = df.sparkSession.sparkContext.broadcast(whole_tokens(path))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def start():
        count = _counter(path, proven).count

        def f(ids, texts):
            n = [count(t) if t else 0 for t in texts]
            return {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return f

    return map_texts(df, start, out, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)


_counters: dict[str, Counter] = {}


def _counter(path: str, proven) -> Counter:
    """A worker's counter of a vocabulary; its memo lasts from task to task."""
    if path not in _counters:
        _counters[path] = Counter(path, whole=proven.value)
    return _counters[path]


def settled(text: str) -> bool:
    """Whether all characters have been in Unicode for so long that no two tables class them differently."""
    return text.isascii() or not any(ucd_3_2_0.category(c) == "Cn" for c in text)


class IdEncoder:
    """Ids of the word-level vocabulary as little-endian 32-bit bytes, memoised by pre-token.

    The library's Unicode tables are its own. A text with a character that was not in Unicode 3.2 is
    left to the library as a whole, as such a character may be cut off or lowered another way there.
    """

    def __init__(self, path: str):
        self.tok, self.findall, self.memo = load(path), regex.compile(WORD_LEVEL).findall, {}
        self.special = _special(path)

    def encode(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in self.special):
            return self.whole(text)
        given = text
        if not text.isascii():
            text = normalize("NFC", text).replace("Σ", "σ")  # the library lowers each character alone
        pre = self.findall(text.lower())
        try:
            return b"".join(map(self.memo.__getitem__, pre))
        except KeyError:
            pass
        except TypeError:  # a character that is not settled
            return self.whole(given)
        if len(self.memo) > MEMO:
            self.memo = {}
        rest = list(set(pre).difference(self.memo))
        for s in rest:
            ids = [t.id for t in merge(self.tok, s)] if settled(s) else None
            self.memo[s] = ids if ids is None else pack(f"<{len(ids)}I", *ids)
        found = [self.memo[s] for s in pre]
        return self.whole(given) if None in found else b"".join(found)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
