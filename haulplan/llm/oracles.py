"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_WORD = r"[^\x20\x09-\x0D]+"
OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM spots),
inside AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM windows WHERE n > 1) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(list_aggregate(ws, 'string_agg', '')) AS chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
  coalesce(lines.n, 0) AS n_lines, coalesce(lines.again, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN inside ON inside.doc_id = w.doc_id),
r AS (SELECT *, CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(100 * n_symbols > 50 * n_words AS INT)
  + 8 * CAST(100 * n_dup_lines > 50 * n_lines AS INT) + 16 * CAST(100 * capitals > 60 * coalesce(chars, 0) AS INT) + 32 * CAST(coalesce(chars, 0) > 25 * n_words AS INT) AS bits FROM m)
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
  CAST(bits AS BIGINT) AS failed_rules FROM r
"""

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first_id < w.doc_id, false) AS INT) AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
p AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || e.f || g.f AS filter_order FROM x a, x b, x c, x e, x g
  WHERE length(replace(replace(replace(replace(replace('ABCDE', a.f, ''), b.f, ''), c.f, ''), e.f, ''), g.f, '')) = 0),
s AS (SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))) AS before
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
a AS (SELECT p.*, filter_order, step, bit, (mask & bit) <> 0 AS hit, (mask & CAST(coalesce(before, 0) AS INT)) <> 0 AS early FROM p, s)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (NOT hit AND NOT early), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT early), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (hit AND early), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (hit AND NOT early), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (hit AND NOT early), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(CAST(mask AS INT)), 1))) FILTER (hit), 0) AS BIGINT) AS shapley
FROM a GROUP BY part, filter_order, step
"""

#: Levels that the SQL below climbs: enough for 8^7 rows of one language.
_LEVELS = 7


def _framed(field: str) -> str:
    return f"coalesce(strlen(CAST({field} AS VARCHAR)) || ':' || CAST({field} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(level: int, below: str, tree: str) -> str:
    """Nodes of a level with their siblings' digests before and after, then their parents."""
    return f"""{tree}{level} AS (SELECT *, i // 8 AS up,
  coalesce(string_agg(h, '') OVER (PARTITION BY part, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY part, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {below}),
{tree}{level}up AS (SELECT part, up AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
  max((n + 7) // 8) AS n FROM {tree}{level} GROUP BY part, up)"""


def _climb(first: str, tree: str) -> str:
    return ",\n".join(_tree(k, first if k == 0 else f"{tree}{k - 1}up", tree) for k in range(_LEVELS))


def _folds(tree: str, part: str, place: str, start: str) -> str:
    """From ``start`` (node, got, proof, place) up to a tree's last node."""
    steps = []
    for k in range(_LEVELS):
        come = start if k == 0 else f"{tree}f{k - 1}"
        steps.append(f"""{tree}f{k} AS (SELECT c.* EXCLUDE (got, proof, {place}), t.up AS {place},
  CASE WHEN t.n = 1 THEN c.got ELSE sha256(t.before || c.got || t.after) END AS got, CASE WHEN t.n = 1 THEN c.proof ELSE c.proof || t.before || t.after END AS proof
  FROM {come} c JOIN {tree}{k} t ON t.part IS NOT DISTINCT FROM c.{part} AND t.i = c.{place})""")
    return ",\n".join(steps)


_BITS = "list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(x AS BIGINT))"
OP13 = f"""
WITH crcs AS (SELECT list({_BITS} ORDER BY x) AS crc FROM (SELECT unnest(range(256)) AS x)),
d AS (SELECT *, {_leaf("text")} AS h, xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda j: CAST(ascii(CAST(doc_id AS VARCHAR)[j]) AS BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc32 FROM documents, crcs),
leaves AS (SELECT doc_id, lang AS part, h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
  CASE WHEN crc32 % 3 = 0 THEN {_leaf("translate(text, '" + _UPPER + "', '" + _LOWER + "')")} ELSE h END AS got FROM d),
{_climb("(SELECT part, h, i, n FROM leaves)", "a")},
subs AS (SELECT part AS lang, h, row_number() OVER (ORDER BY part NULLS FIRST) - 1 AS i, count(*) OVER () AS n, 0 AS part FROM a{_LEVELS - 1}up),
{_climb("(SELECT part, h, i, n FROM subs)", "b")},
start AS (SELECT doc_id, part, h AS leaf, got, '' AS proof, i FROM leaves),
{_folds("a", "part", "i", "start")},
mid AS (SELECT f.doc_id, f.leaf, f.got, f.proof, s.h AS subroot, s.i, 0 AS part FROM af{_LEVELS - 1} f JOIN subs s ON s.lang IS NOT DISTINCT FROM f.part),
{_folds("b", "part", "i", "mid")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, got AS folded_root, got = r.h AS verified
FROM bf{_LEVELS - 1}, b{_LEVELS - 1}up r
"""

ORACLES = {"op1_line_dedup": OP1, "op3_quality": OP3, "op12_filter_audit": OP12, "op13_merkle": OP13}
