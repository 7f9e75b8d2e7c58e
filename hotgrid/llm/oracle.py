"""SQL for an independent engine, of the operators whose results SQL can express."""

from __future__ import annotations

from hotgrid.llm import quality

ORACLE_SQL: dict[str, str] = {
    "op8_warc": """SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url, request_id
FROM (SELECT *, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(url, '') AS url,
'<urn:capture:request:' || page_id || '>' AS request_id, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS last FROM pages))""",
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op6_decontamination"] = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS words
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hits AS (SELECT rid, i, dw.k, item FROM dw JOIN iw USING (k, words)),
places AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM hits) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item)) AS found FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)"""


def _quality_sql() -> str:
    p, rules = quality.RISK / len(quality.CANDIDATES), list(quality.CANDIDATES)
    alpha = quality.ERROR / (quality.STRATA * len(rules))
    tests = ", ".join(f"{{'rule': '{r}', 'cutoff': CAST({c!r} AS DOUBLE), 'hit': {r} > CAST({c!r} AS DOUBLE)}}" for r in rules for c in quality.CANDIDATES[r])
    failed = ", ".join(f"CASE WHEN m.{r} > (SELECT cutoff FROM cutoffs c WHERE c.stratum = m.stratum AND c.rule = '{r}') THEN '{r}' END" for r in rules)
    space = r"\x20\x09-\x0D"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(text, '[^{space}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines FROM t),
win AS (SELECT rid, i, array_to_string(words[i : i + 7], ' ') AS eight FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, eight) AS n FROM win) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY rid),
c AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, array_to_string(words, '') AS glued, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(words, lambda x: length(x) > 30)) AS n_long
  FROM w LEFT JOIN repeated ON w.rid = repeated.rid),
s AS (SELECT *, CAST(length(glued) AS BIGINT) AS word_chars, CAST(length(regexp_replace(glued, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  length(regexp_replace(glued, '[^A-Za-z]+', '', 'g')) AS n_letters, length(regexp_replace(glued, '[^A-Z]+', '', 'g')) AS n_upper FROM c),
m AS (SELECT rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  {share("n_symbols", "word_chars")} AS symbol_ratio, {share("n_dup_lines", "n_lines")} AS dup_line_ratio, {share("n_repeat_words", "n_words")} AS repeat_ratio,
  {share("n_long", "n_words")} AS long_word_ratio, {share("n_upper", "n_letters")} AS upper_ratio,
  CASE WHEN n_words < 150 THEN 'short' WHEN n_words < 500 THEN 'medium' ELSE 'long' END AS stratum FROM s),
good AS (SELECT m.* FROM m JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
counted AS (SELECT stratum, x.rule AS rule, x.cutoff AS cutoff, count(*) AS n, count(*) FILTER (x.hit) AS k FROM (SELECT stratum, unnest([{tests}]) AS x FROM good) GROUP BY ALL),
tails AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r}))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM counted WHERE k <= n * {p!r}) GROUP BY ALL),
cutoffs AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE tail <= {alpha!r} GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept, failed AS failed_rules
FROM (SELECT m.*, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM m)"""


ORACLE_SQL["op3_quality_rules"] = _quality_sql()


def _crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


#: Levels of a source's tree, and of the tree of sources, that the SQL unrolls: 16^5 rows a source, 16^3 sources.
_LEVELS, _TOPS = 5, 3


def _manifest_sql() -> str:
    """Each level is a table: a node, its place, how many its tree has there, and its siblings left and right of it."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"""WITH d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(low)} END AS other FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
s0 AS (SELECT source AS tree, pos, leaf AS digest FROM n)"""]

    def levels(name: str, n: int) -> None:
        for k in range(n):
            sql.append(f"""{name}r{k} AS (SELECT tree, pos // 16 AS up, list(digest ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY tree) AS size FROM {name}{k} GROUP BY tree, pos // 16),
{name}{k + 1} AS (SELECT tree, up AS pos, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {name}r{k})""")

    levels("s", _LEVELS)
    sql.append(f"t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos, digest, tree AS source FROM s{_LEVELS})")
    levels("t", _TOPS)
    sql.append("p0 AS (SELECT n.*, pos AS place, '' AS proof, coalesce(other, leaf) AS acc FROM n)")

    def walk(name: str, n: int, k: int, key: str) -> int:
        for i in range(n):
            left, right = "array_to_string(run[1 : p.place % 16], '')", "array_to_string(run[p.place % 16 + 2 :], '')"
            sql.append(f"""p{k + 1} AS (SELECT p.* EXCLUDE (place, proof, acc), p.place // 16 AS place, CASE WHEN size > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
CASE WHEN size > 1 THEN sha256({left} || acc || {right}) ELSE acc END AS acc FROM p{k} p JOIN {name}r{i} r ON r.tree IS NOT DISTINCT FROM {key} AND r.up = p.place // 16)""")
            k += 1
        return k

    k = walk("s", _LEVELS, 0, "p.source")
    sql.append(f"p{k + 1} AS (SELECT p.* EXCLUDE (place), t.digest AS subroot, t.pos AS place FROM p{k} p JOIN t0 t ON t.source IS NOT DISTINCT FROM p.source)")
    k = walk("t", _TOPS, k + 1, "0")
    return ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.digest AS verified FROM p{k} CROSS JOIN t{_TOPS} t"""


ORACLE_SQL["op12_merkle_manifest"] = _manifest_sql()
