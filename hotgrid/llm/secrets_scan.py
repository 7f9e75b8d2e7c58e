"""Secret scans (operator 2): assignment-aware lexing of source and configuration syntax.

The lexer turns ``name = literal``, ``"name": "literal"``, ``name=literal`` (shell, ini),
``name: literal`` (yaml), ``<name>literal</name>`` and calls ``set_name("literal")`` into
name-literal pairs. Names that are bound to constants are propagated: in ``a = "x"`` and
``db_password = a + "y"`` the password is "xy". A pair is scored by how sensitive its
name is and how much its literal looks like a key rather than a word. The spans are those
of the literals themselves, wherever they were bound, not of the names that stand for them. A PEM block
is a literal too, whose name is its label: that of a private key is a secret.

A quoted literal may have any printable characters but spaces, one without quotes only those of keys.
Templates ("${TOKEN}", "{{ token }}", "<your-token>") are no constants. Literals of several words, and those of
letters alone, are not told from prose and are left to the base patterns.

A bound value is kept as a count of its characters and links to its parts, never as a string:
``a = a + a`` doubles a number, and a text is lexed in time and memory that grow with its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from hotgrid.llm.common import map_texts

#: The base patterns and least lengths of the contract (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same as runs that are then filtered
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Order of kinds for spans that start together.
KINDS = ("assign", "access", "hex", "lexed")
#: How sensitive a name is whose last or only part is this.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.8,
    "signingkey": 1.0, "encryptionkey": 1.0, "clientsecret": 1.0, "connectionstring": 0.7, "dsn": 0.6,
}
#: Words in a name that make a sensitive part harmless: what follows is a place or a policy.
HARMLESS = frozenset("file path url uri dir length len size min max count type name field policy hint label id ttl expiry regex pattern".split())
THRESHOLD = 0.55

_TOKENS = re.compile(
    r"""(?P<xml><(?P<xn>[A-Za-z_][\w.-]++)>(?P<xv>[^<>\s]{6,}+)</(?P=xn)>)"""
    # a run of name characters is read once, from its start
    r"""|(?<![\w.$-])[.-]*+(?P<name>[\w$][\w.$-]*+)"""
    r"""(?:["']?\]?[ \t]*(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*(?P<value>[^\s])|\([ \t]*(?P<cv>"[^"\n]{6,}+"|'[^'\n]{6,}+')[ \t]*\))"""
)
_ATOM = re.compile(r"""[ \t]*(?:[rbuf]?"((?:[^"\\\n]|\\.)*)"|[rbuf]?'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|\$\{?([A-Za-z_]\w*)\}?|([^\s,;"'`(){}<>\[\]|]+))""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?=[\"'`A-Za-z_$])")
#: Base64 characters that a private key has at least.
PEM_CHARS = 64
# the body ends before the next five dashes, so a text is read once however many blocks begin in it
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----((?:[^-]|-(?!----))*+)")
_TEMPLATE = re.compile(r"\$\{|\$\(|\{\{|\{[A-Za-z_]\w*\}|%\(|<%|\A<[^<>]*>\Z|\A\[[^\[\]]*\]\Z")
_PLAIN = re.compile(r"[A-Za-z0-9+/_.=!@#$%^&*~:-]+\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    return max(SENSITIVE.get(x, 0.0) for x in (parts[-1], "".join(parts[-2:]), parts[-1].rstrip("s")))


#: Characters of a value beyond which its counts are halved: only a text that doubles a name gets there.
VAST = 1 << 40


@dataclass(eq=False)
class Value:
    """A constant: how often each character occurs in it, and the spans or values it is made of."""

    counts: dict[str, int]
    parts: tuple
    seen: bool = False

    @property
    def size(self) -> int:
        return sum(self.counts.values())

    def spans(self) -> list[tuple[int, int]]:
        """Spans of its literals that no call before has given: all calls together visit each part once."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if v.seen:
                continue
            v.seen = True
            for p in v.parts:
                if isinstance(p, Value):
                    todo.append(p)
                else:
                    out.append(p)
        return out


def joined_value(parts: list) -> Value:
    """The value of ``parts`` one after another; each is a Value or (characters, start, end)."""
    if len(parts) == 1 and isinstance(parts[0], Value):
        return parts[0]
    counts: Counter = Counter()
    for p in parts:
        counts.update(p.counts if isinstance(p, Value) else p[0])
    while sum(counts.values()) > VAST:
        counts = Counter({c: (k + 1) // 2 for c, k in counts.items()})
    return Value(counts, tuple(p if isinstance(p, Value) else p[1:] for p in parts))


def likeness(counts: dict[str, int]) -> float:
    """0 to 1: a literal's length, mixture of kinds of characters and entropy."""
    n = sum(counts.values())
    if n < 8 or not all(c.isprintable() and not c.isspace() for c in counts):
        return 0.0
    kinds = any(c.isdigit() for c in counts) + any("a" <= c <= "z" for c in counts) + any("A" <= c <= "Z" for c in counts) + any(not (c.isascii() and c.isalnum()) for c in counts)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    if not any(c.isdigit() for c in counts) or kinds < 2:
        return 0.3 * min(1, entropy / 4)  # a word or a number
    return min(1.0, 0.25 + 0.15 * (kinds - 1) + 0.1 * min(2, n / 16) + 0.25 * min(1, entropy / 3.5))


def lex(text: str) -> list[tuple[str, Value]]:
    """(name, value) of every assignment of a constant; bound constants are propagated."""
    env: dict[str, Value] = {}
    out = []
    at = 0
    while m := _TOKENS.search(text, at):
        if m["xml"]:
            out.append((m["xn"], joined_value([(m["xv"], m.start("xv"), m.end("xv"))])))
            at = m.end()
        elif m["cv"]:
            out.append((m["name"], joined_value([(m["cv"][1:-1], m.start("cv") + 1, m.end("cv") - 1)])))
            at = m.end()
        else:
            parts, end, pos, more = [], -1, m.start("value"), True
            while more and (a := _ATOM.match(text, pos)):
                k = a.lastindex
                known = env.get(a[k]) if k > 3 else None
                if known is None and k == 4:
                    break
                if known is None and a[k] and (text.startswith("(", a.end()) or not _PLAIN.match(a[k]) if k == 5 else _TEMPLATE.search(a[k])):
                    parts, end = [], a.end()  # a call, a template or prose is no constant
                    break
                if known is not None or a[k]:
                    parts.append(known if known is not None else (a[k], a.start(k), a.end(k)))
                end = pos = a.end()
                p = _PLUS.match(text, pos)
                more, pos = bool(p), p.end() if p else pos
            if parts:
                value = joined_value(parts)
                env[m["name"].rpartition(".")[2]] = value
                out.append((m["name"], value))
            at = max(end, m.end("name") + 1)
    return out


def private_keys(text: str) -> list[tuple[int, int]]:
    """Spans of the bodies of PEM blocks of private keys, cut off ones included, without the spaces around."""
    out = []
    for m in _PEM.finditer(text):
        body = m[1].strip()
        if sum(c.isascii() and (c.isalnum() or c in "+/=") for c in body) >= PEM_CHARS:
            start = m.start(1) + len(m[1]) - len(m[1].lstrip())
            out.append((start, start + len(body)))
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the intervals that the spans cover together."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text in code points.

    A lexed span is left out only where the base spans cover it whole.
    """
    if not text:
        return []
    low = text.lower()
    spans = []
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found = private_keys(text) if "PRIVATE KEY" in text else []
    if "=" in text or ":" in text or "(" in text or "</" in text:  # else there is no pair
        for name, value in lex(text):
            if not value.seen and (s := sensitivity(name)) and s * likeness(value.counts) >= THRESHOLD:
                found += value.spans()
    if found:
        starts, ends = _merged([(a, b) for a, b, _ in spans])
        for a, b in found:
            i = bisect_right(starts, a) - 1
            if i < 0 or ends[i] < b:
                spans.append((a, b, "lexed"))
    return sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(text: str | None) -> tuple[int, int, int, str, str]:
    spans = scan(text)
    base = [x for x in spans if x[2] != "lexed"]
    n = Counter(k for _, _, k in base)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: one row per row of ``df``, no shuffle.

    Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans. A null or empty text has
    no spans (the digest of the empty string). A text of any length is scanned whole, in time
    that grows with it. Repeated rows give repeated rows, spans that start together are in the
    order of KINDS; an empty table gives none. Other columns of ``df`` are not read.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    out = pa.schema([(n, pa.string() if n in names[4:] else pa.int64()) for n in names])

    def start():
        def f(ids, texts):
            return dict(zip(names, [ids, *map(list, zip(*map(digest, texts), strict=True))], strict=True))

        return f

    return map_texts(df, start, out, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", id_col, text_col)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans by one mark."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in scan(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with the secrets in its texts replaced and the lengths made to fit; no shuffle.

    All rows and columns are kept; a null text stays null and so does its length.
    """
    at = df.columns.index(text_col)
    long = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [redact(t, mark) for t in part.column(at).to_pylist()]
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                if long is not None:
                    kind = part.schema.field(long)
                    part = part.set_column(long, kind, pa.array([None if t is None else len(t) for t in texts], kind.type))
                yield part

    return df.mapInArrow(run, df.schema)
