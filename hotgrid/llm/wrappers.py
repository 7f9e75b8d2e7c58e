"""HTML extraction (operator 1) by union-free regular expressions inferred for each host.

A page is a stream of tags and texts. Two streams of one host are aligned: where both have
the same tag their contents are aligned in turn; differing texts become a slot; tags that
only one stream has become optional groups, and equal neighbours repeated groups. The result
is a regular expression without unions, the host's wrapper, and aligning wrappers works like
aligning pages. So every task folds its pages into one wrapper per host, and the partial
wrappers of a host are aligned in two further steps, however many pages the host has.

Extraction aligns each page with its host's wrapper. Texts in slots that have one and the same
text on three or more pages are the host's and go, inside of articles too. On pages without an
article element so do the texts that half of the pages repeat in a slot that varies, like a menu's
entries. Lists of tags and of words in class, id and role then find the article and leave out
what differs from page to page but is no part of it, like comments.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
#: Elements that end a block of text and start another.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: An opened element of the key closes an open one of the values.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose text is never the article's.
OUTSIDE = frozenset("nav footer aside form script style noscript template head button select menu dialog iframe svg canvas object map search textarea".split())
#: Words in class, id or role that say so of any element.
OUTSIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promotion navbar navigation breadcrumb breadcrumbs sidebar footer
    masthead topbar toolbar comment comments comentarios kommentare commentaires disqus cookie cookies consent popup modal newsletter
    subscribe pagination pager contentinfo""".split()
)
#: Words that say so alone, or beside others that only tell a place or a form ("share-buttons", but not "share-price").
OUTSIDE_ALONE = OUTSIDE_WORDS | frozenset(
    """nav menu banner promo widget aside respond reply replies discussion notice notices alert overlay signup login share sharing social
    related recommended skip complementary search""".split()
)
FORMS = frozenset(
    """list box bar link links button buttons btn wrap wrapper container section area block item items post posts article articles story
    stories content contents page site header form icon icons panel top bottom left right inner outer main primary secondary body group
    row col column zone slot card cards module region toggle message msg to""".split()
)
#: Words that make of a class a state of the page ("has-sidebar", "comments-open", "layout-fixed-footer"): it tells nothing of its element.
STATES = frozenset("has no not non with without is layout open opened close closed on off enabled disabled allowed active above below before after".split())
#: Words of the lists that also begin names of other things ("ad-hoc-analysis", "comment-on-art"): first in a name they do not decide.
UNSURE = frozenset("ad ads comment footer".split())
#: Elements that hold prose: for them a word of the lists has to be the whole class, id or role.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre code td th dt dd b i em strong a span figure figcaption".split())
MAIN_WORDS = frozenset("main article articlebody".split())
#: Wrappers nest so deep; what is deeper they hold as a flat sequence of its tags and texts.
DEPTH = 60
#: Bytes of wrappers that may be broadcast; more are joined by host.
BROADCAST_BYTES = 32_000_000
#: Hosts whose wrappers a task holds before it hands them on.
HOSTS = 2_000
#: Tasks that the pages of one host are dealt to where the wrappers are joined.
SALTS = 32
PERIODS = (1, 2, 3)
#: Units of a sequence that pages of a host may differ in before it is held as a bag, one unit of each name.
WIDE = 64
#: A slot's text is the host's if it is the same on so many pages that differ in content.
PAGES = 3
#: Texts that a slot remembers, to find those on half of its pages; the rarest of more are forgotten.
TEXTS = 200

# quotes count only after an equals sign: elsewhere, and inside an unquoted value, they are plain characters
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^>=]++)*+)>|([^<]+|<)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")


def key_of(tag: str, attrs: str) -> str:
    """Tag and the words of class, id and role without digits: what alignment compares."""
    if not attrs or attrs.isspace():
        return tag
    words = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        words += ["hidden"] if name == "hidden" else ["-".join(w for w in _WORDS.findall(x) if not w.isdigit()) for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split()]
    return ".".join([tag, *sorted({w for w in words if w})])


def tree(page: str) -> list:
    """The page as nested [key, children]; a child is a node or a text. Any markup is accepted."""
    root = ["html", []]
    stack, names = [root], ["html"]
    places: dict[str, list[int]] = {}  # of the open elements with a name, the outermost first
    blocks: list[int] = []

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(to: int) -> None:
        for name in names[to:]:
            places[name].pop()
        while blocks and blocks[-1] >= to:
            blocks.pop()
        del stack[to:], names[to:]

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        if not m:
            break
        pos = m.end()
        if m[4] == "<" and page[pos : pos + 1].isalpha() and page.find(">", pos) < 0:
            break  # a tag that never ends
        if m[4] is not None:
            stack[-1][1].append(m[4])
            continue
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1][1].append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            at = last(tag)
            if at and (tag in BLOCK or not blocks or blocks[-1] < at):
                close(at)  # an inline end tag does not close the block around it
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag in BLOCK and blocks and names[blocks[-1]] == "p":
            close(blocks[-1])
        if tag in IMPLIED:
            while (at := last(*IMPLIED[tag])) > last("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select"):
                name = names[at]
                close(at)
                if not (tag == "tr" and name != "tr"):
                    break
        node = [key_of(tag, m[3]), []]
        stack[-1][1].append(node)
        if tag not in VOID and (not m[3].rstrip().endswith("/") or tag in BLOCK):
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
            names.append(tag)
    return root


# A wrapper's units: ["t", constant or None, optional, contents, pages, usual], ["e", key, units, optional, repeated]
# and ["g", units, optional, repeated] for repeated groups of several units, with "bag" added if the units may
# be in any order. The contents of a
# constant are digests of the first PAGES (by digest) different contents of pages that have it.
# On pages without an article element a slot also counts the pages that have it and, of each text
# in it that recurs, the pages and contents: in a menu every entry is usual, though the slot varies.


def name(unit: list) -> str:
    return "#" if unit[0] == "t" else unit[1] if unit[0] == "e" else "(" + " ".join(map(name, unit[1])) + ")"


def digest(text: str) -> str | None:
    """Of a text but for its spaces; None of one without more."""
    text = " ".join(html.unescape(text).split())
    return hashlib.sha1(text.encode()).hexdigest()[:12] if text else None


def members(node: list, depth: int) -> list[tuple[list, int, bool]]:
    """(node, number of the child, whether its own children follow here) of what a wrapper holds at this depth."""
    if depth < DEPTH:
        return [(node, i, False) for i in range(len(node[1]))]
    out, todo = [], [(node, 0)]
    while todo:
        node, i = todo.pop()
        if i < len(node[1]):
            out.append((node, i, True))
            todo.append((node, i + 1))
            if not isinstance(node[1][i], str):
                todo.append((node[1][i], 0))
    return out


def _unit(child, page: str, count: bool, depth: int = 0, flat: bool = False) -> list | None:
    if isinstance(child, str):
        d = digest(child)
        return ["t", d, 0, [page], int(count), {d: [1, [page]]} if count else {}] if d else None
    count = count and not outside(child[0])
    inner = [] if flat else fold([u for n, i, f in members(child, depth) if (u := _unit(n[1][i], page, count, depth + 1, f))])
    return ["e", child[0], inner, 0, 0]


def infer(page: list) -> list:
    """The page's own expression, equal neighbours folded into repeated groups."""
    return _unit(page, hashlib.sha1(content(page).encode()).hexdigest()[:12], not _page_root(page))


def _usual(a: list, b: list, same: bool) -> list:
    """Pages and texts of two slots together: of the ``same`` pages, or of different ones."""
    pages, out = (max if same else int.__add__)(a[4], b[4]), dict(a[5])
    for d, (n, contents) in b[5].items():
        m, known = out.get(d, (0, []))
        out[d] = [max(m, n) if same else m + n, sorted({*known, *contents})[:PAGES]]
    if len(out) > TEXTS:  # those that recur stay; a text on most pages recurs long before the others fill the slot
        out = {d: out[d] for d in sorted(out, key=lambda d: (-len(out[d][1]), -out[d][0], d))[: TEXTS // 2]}
    return [pages, out]


def merge(a: list, b: list, same: bool = False) -> list:
    """The expression that covers both of two units with one name, of different pages or of the same."""
    if a[0] == "t":
        usual = _usual(a, b, same)
        if a[1] is None or a[1] != b[1]:
            return ["t", None, a[2] | b[2], [], *usual]
        return ["t", a[1], a[2] | b[2], a[3] if a[3] == b[3] else sorted({*a[3], *b[3]})[:PAGES], *usual]
    if a[0] == "g" and (is_bag([a]) or is_bag([b])):
        return bags([a], [b], same)[0]
    if a[0] == "g":
        return ["g", align(a[1], b[1], same), a[2] | b[2], a[3] | b[3]]
    return ["e", a[1], align(a[2], b[2], same), a[3] | b[3], a[4] | b[4]]


def _optional(unit: list) -> list:
    u = list(unit)
    u[2 if u[0] in "tg" else 3] = 1
    return u


def align(a: list[list], b: list[list], same: bool = False) -> list[list]:
    """Align two sequences of units; what only one has becomes optional, then neighbours fold.

    Sequences that differ so much that over WIDE units come of it are held as one repeated group of
    optional units, each name once: no longer than the names that the host uses, whatever its pages.
    """
    if is_bag(a) or is_bag(b):
        return bags(a, b, same)
    x, y = [*map(name, a)], [*map(name, b)]
    if x == y:
        return [merge(u, v, same) for u, v in zip(a, b, strict=True)]
    out = []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge(u, v, same) for u, v in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += map(_optional, a[i:j])
            out += map(_optional, b[k:m])
    out = fold(out)
    return bags(a, b, same) if len(out) > WIDE else out


def is_bag(units: list[list]) -> bool:
    return len(units) == 1 and units[0][0] == "g" and len(units[0]) > 4


def bag(units: list[list]) -> dict[str, list]:
    """One optional unit a name, merged from all that have it; groups are opened."""
    out: dict[str, list] = {}
    todo = units[::-1]
    while todo:
        u = todo.pop()
        if u[0] == "g":
            todo += u[1][::-1]
        else:
            out[name(u)] = merge(out[name(u)], u, True) if name(u) in out else _optional(u)
    return out


def bags(a: list[list], b: list[list], same: bool) -> list[list]:
    """Two sequences as one bag: what is one after the other may be in any order."""
    x, y = bag(a), bag(b)
    units = [merge(x[n], y[n], same) if n in x and n in y else x.get(n) or y[n] for n in sorted({*x, *y})]
    return [["g", units, 1, 1, "bag"]]


def fold(units: list[list]) -> list[list]:
    """Equal neighbours, alone or in groups of two or three, become one repeated group."""
    for p in PERIODS:
        out: list[list] = []
        for u in units:
            out.append(u)
            names = [*map(name, out[-2 * p :])]
            if len(out) < 2 * p or names[:p] != names[p:]:
                if p > 1 and len(out) > p and out[-p - 1][0] == "g" and [*map(name, out[-p - 1][1])] == [*map(name, out[-p:])]:
                    group, more = out[-p - 1], out[-p:]
                    out[-p - 1 :] = [["g", [merge(x, y, True) for x, y in zip(group[1], more, strict=True)], group[2], 1]]
                continue
            first, second = out[-2 * p : -p], out[-p:]
            if p == 1:
                one = merge(first[0], second[0], True)
                if one[0] != "t":
                    one[-1] = 1
                out[-2:] = [one]
            elif len(set(names[:p])) > 1:
                out[-2 * p :] = [["g", [merge(x, y, True) for x, y in zip(first, second, strict=True)], 0, 1]]
        units = out
    return units


@functools.lru_cache(65_536)
def outside(key: str) -> bool:
    """Whether an element's text is never the article's, by its tag and the words of class, id and role.

    Of a name in several parts the last decides ("reader-comments"), or the first where it is not UNSURE
    ("cookie-law"), or all of them; a name that tells a state of the page does not count.
    """
    tag, *words = key.split(".")
    if tag in OUTSIDE or "hidden" in words:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in PROSE:
        return bool(OUTSIDE_ALONE.intersection(words))
    for parts in (w.split("-") for w in words):
        if STATES.intersection(parts):
            continue
        if parts[-1] in OUTSIDE_WORDS or parts[0] in OUTSIDE_WORDS - UNSURE or (OUTSIDE_ALONE.intersection(parts) and not set(parts) - OUTSIDE_ALONE - FORMS):
            return True
    return False


@functools.lru_cache(65_536)
def _is_root(key: str) -> bool:
    tag, *words = key.split(".")
    return tag in ("article", "main") or any(MAIN_WORDS.intersection(w.split("-")) for w in words)


class Slots:
    """A wrapper's sequence of units, made ready to be matched with a page's children in order.

    Groups are laid flat. ``back[p]`` is the first place that may follow place p: p itself
    if its unit repeats, the group's start within a repeated group, else the next place.
    """

    def __init__(self, units: list[list]):
        self.units, self.back, self.group, self.must = [], [], [], [0]
        self._flatten(units, None, True)
        self.at: dict[str, list[int]] = {}
        for p, u in enumerate(self.units):
            self.at.setdefault(name(u), []).append(p)
        self.inner = [Slots(u[2]) if u[0] == "e" and not outside(u[1]) else None for u in self.units]
        #: Whether any text here or deeper is fixed: else there is nothing to match for.
        self.often = [self.usual(p) for p in range(len(self.units))]
        self.any = any(map(self.fixed, range(len(self.units)))) or any(self.often) or any(x is not None and x.any for x in self.inner)

    def _flatten(self, units: list[list], group: int | None, must: bool) -> None:
        for u in units:
            p = len(self.units)
            if u[0] == "g":
                self._flatten(u[1], p if group is None else group, must and not u[2])
                continue
            self.units.append(u)
            self.group.append(group)
            self.back.append(group if group is not None else p if u[0] == "t" or u[4] else p + 1)
            self.must.append(self.must[-1] + (must and not u[2 if u[0] == "t" else 3]))

    def fixed(self, p: int) -> bool:
        """Whether the text in this place belongs to the host and not to a page."""
        u = self.units[p]
        return u[0] == "t" and u[1] is not None and len(u[3]) >= PAGES

    def usual(self, p: int) -> set[str]:
        """Digests of the texts in this place that half of its pages have, PAGES of different content at least."""
        u = self.units[p]
        return {d for d, (n, contents) in u[5].items() if len(contents) >= PAGES and 2 * n >= u[4]} if u[0] == "t" else set()

    def match(self, children: list) -> list[int | None]:
        """The place of each child: of all ways through the units that with the fewest left out.

        A constant takes only its own text. A child that no way reaches has no place.
        """
        found: list[int | None] = [None] * len(children)
        ways: dict[int, float] = {-1: 0}
        steps = []
        for i, c in enumerate(children):
            if isinstance(c, str):
                d = digest(c)
                places = d and [p for p in self.at.get("#", ()) if self.units[p][1] in (None, d)]
            else:
                places = self.at.get(c[0])
            if not places:
                continue
            # every way as the left-outs up to a place ahead, and within a repeated group
            ahead = sorted((p, cost - self.must[p + 1]) for p, cost in ways.items())
            loops: dict[int, tuple[float, int]] = {}
            for p, cost in ways.items():
                g = self.group[p] if p >= 0 else None
                if g is not None and (g not in loops or (cost, p) < loops[g]):
                    loops[g] = cost, p
            k, best, new, came = 0, None, {}, {}
            for q in places:
                while k < len(ahead) and ahead[k][0] < q:
                    if best is None or ahead[k][1] < best[0]:
                        best = ahead[k][1], ahead[k][0]
                    k += 1
                options = [(best[0] + self.must[q], best[1])] if best else []
                if self.group[q] in loops:
                    options.append(loops[self.group[q]])
                if q in ways and self.back[q] == q:
                    options.append((ways[q], q))
                if options:
                    new[q], came[q] = min(options)
            if new:
                steps.append((i, came))
                ways = new
        last = min(ways, key=lambda p: (ways[p] + self.must[-1] - self.must[p + 1], p))
        for i, came in reversed(steps):
            found[i], last = last, came[last]
        return found


@functools.lru_cache(20_000)
def _loaded(wrapper: str) -> Slots:
    return Slots(json.loads(wrapper)[2])


def fixed_texts(node: list, slots: Slots) -> set[tuple[int, int]]:
    """(id of the node, number of the child) of the page's texts that its host's wrapper has fixed."""
    out: set[tuple[int, int]] = set()
    todo = [(node, slots, 0)]
    while todo:
        node, slots, depth = todo.pop()
        if not slots.any:
            continue
        inner = members(node, depth)
        for (owner, i, flat), p in zip(inner, slots.match([n[1][i] for n, i, _ in inner]), strict=True):
            if p is None:
                continue
            if slots.inner[p] is not None:
                if not flat:
                    todo.append((owner[1][i], slots.inner[p], depth + 1))
            elif slots.fixed(p) or (slots.often[p] and digest(owner[1][i]) in slots.often[p]):
                out.add((id(owner), i))
    return out


def _page_root(node: list) -> bool:
    todo = [node]
    while todo:
        for c in todo.pop()[1]:
            if not isinstance(c, str) and not outside(c[0]):
                if _is_root(c[0]):
                    return True
                todo.append(c)
    return False


def content(node: list, fixed: set[tuple[int, int]] = frozenset()) -> str:
    """The text of a page's article or main element, or of all the page without one, but for ``fixed``."""
    blocks: list[list[str]] = [[]]
    whole = not _page_root(node)
    todo = [(node, 0, False, False)]
    while todo:
        node, i, inside, block = todo.pop()
        children = node[1]
        while i < len(children):
            child = children[i]
            i += 1
            if isinstance(child, str):
                if (inside or whole) and (id(node), i - 1) not in fixed:
                    blocks[-1].append(child)
                continue
            key = child[0]
            if outside(key):
                continue
            tag = key.partition(".")[0]
            if tag == "header" and not inside:
                continue
            if tag in BLOCK:
                blocks.append([])
            elif tag == "br":
                blocks[-1].append(" ")
            todo += [(node, i, inside, block), (child, 0, inside or _is_root(key), tag in BLOCK)]
            break
        else:
            if block:
                blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(page: str | None, wrapper: str) -> str:
    """The article's text: the page is aligned with its host's wrapper, and texts in fixed slots go.

    Of a page with an article or main element the texts inside count, of one without all
    outside of menus and the like. Fixed are the slots whose text is the same on three or
    more pages of different content, so copies of a page do not make its text the host's.
    """
    if not page:
        return ""
    node = tree(page)
    return content(node, fixed_texts(node, _loaded(wrapper)))


def host(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _dump(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)


def _combine(parts) -> list:
    """Align wrappers in the order of their text, so that the result does not depend on arrival."""
    return functools.reduce(merge, map(json.loads, sorted(parts)))


_WRAPPERS = pa.schema([("host", pa.string()), ("salt", pa.int64()), ("wrapper", pa.string())])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """(host, wrapper): one wrapper for every host, inferred from all of its pages.

    What is shuffled are the wrappers of tasks, one per host and task (more where a task meets over
    HOSTS hosts), not the pages. Those
    of a host meet by ``salts`` groups first, so that no group grows with the host's pages.
    """

    def fold_pages(batches):
        found: dict[str, list] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for url, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h, own = host(url), infer(tree(page or ""))
                    found[h] = merge(found[h], own) if h in found else own
                if len(found) > HOSTS:
                    yield from sent(found)
                    found = {}
        yield from sent(found)

    def sent(found: dict[str, list]):
        rows = [(h, int(hashlib.sha1(w.encode()).hexdigest()[:8], 16) % salts, w) for h, x in found.items() for w in [_dump(x)]]
        for at in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 500], strict=True), _WRAPPERS, strict=True)], schema=_WRAPPERS)

    def combined(t: pa.Table) -> pa.Table:
        return pa.table([[t["host"][0].as_py()], [0], [_dump(_combine(t["wrapper"].to_pylist()))]], schema=_WRAPPERS)

    ddl = "host string, salt long, wrapper string"
    parts = pages.select(url_col, html_col).mapInArrow(fold_pages, ddl)
    return parts.groupBy("host", "salt").applyInArrow(combined, ddl).groupBy("host").applyInArrow(combined, ddl).select("host", "wrapper")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null or empty html has empty text; a null url is host "". Pages of any length and depth are read
    whole. Broken markup, tags that
    never end and unknown elements are read as browsers do, near enough: no page fails. Rows
    that repeat give a row each, an empty table none; other columns are not read.

    The wrappers are broadcast only if they are at most ``broadcast_bytes``; else pages and
    wrappers are joined by host and salt, so that a hot host's pages are split over SALTS tasks.
    """
    wrappers = written(infer_wrappers(pages, url_col, html_col), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    host_col = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.lower(host_col).alias("host"))
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(wrappers), "host", "left")
    else:
        dealt = wrappers.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "_salt"], "left")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    plain = _dump(["e", "html", [], 0, 0])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(page, w or plain) for page, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
