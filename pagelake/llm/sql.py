"""DuckDB SQL for the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from pagelake.llm import divergence, mixing, quality_rules, sharding

_WORD = r"[^\x20\x09-\x0D]+"


def _rule(rule: quality_rules.Rule) -> str:
    sides = []
    if rule.low is not None:
        sides.append(f"{rule.measure} >= {rule.low}")
    if rule.high is not None:
        sides.append(f"{rule.measure} <= {rule.high}")
    return "(" + " AND ".join(sides) + ")"


def quality_rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    rules = " AND ".join(_rule(r) for r in quality_rules.RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM q) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, len(lines) AS n_lines,
  len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullets,
  len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipses
  FROM t LEFT JOIN rep ON t.r = rep.r),
s AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio,
  CASE WHEN n_lines > 0 THEN n_ellipses / n_lines ELSE 0 END AS ellipsis_line_ratio,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND {rules}) AS kept FROM s
"""


def mixing_sql() -> str:
    w = mixing.WEIGHTS
    turn = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(w))
    z = "CASE WHEN {p} >= 1 THEN 0.0 WHEN {p} <= 0 THEN 1.0 ELSE u * (1 - {p}) / (u * (1 - {p}) + (1 - u) * {p}) END"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(w)} {turn} END::DOUBLE AS weight,
  source_size * {mixing.MAX_REPEATS} AS lim FROM s),
run AS (SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0) AS lft,
  sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share FROM ranked
  WINDOW o AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, lft::DOUBLE / share AS level FROM run),
one AS (SELECT arg_min(level, struct_pack(k := lim / weight, n := source IS NULL, s := source)) AS level FROM lev WHERE lim >= level * weight),
plan AS (SELECT source, source_size, least(lim::DOUBLE, coalesce(one.level, 0) * weight) AS target FROM lev, one),
e AS (SELECT d.doc_id, d.source, d.size, source_size, target,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS certain,
  (('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)} AS u
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
f AS (SELECT *, greatest(target - certain * source_size, 0.0) AS wanted FROM e),
rounds AS (SELECT 0 AS step, source, doc_id, size, u, sum(size) AS words, wanted, FALSE AS taken FROM f
  WHERE wanted > 0 AND size > 0 GROUP BY source, doc_id, size, u, wanted
  UNION ALL SELECT step + 1, source, doc_id, size, u, words, gap, fits AND upto <= wanted FROM (
    SELECT *, wanted - coalesce(max(upto) FILTER (fits AND upto <= wanted) OVER (PARTITION BY source), 0) AS gap FROM (
      SELECT *, sum(words) FILTER (fits) OVER (PARTITION BY source, fits ORDER BY z, doc_id NULLS FIRST, size) AS upto FROM (
        SELECT *, {z.format(p="p")} AS z FROM (
          SELECT *, wanted * size / sum(CASE WHEN fits THEN size::HUGEINT * words::HUGEINT ELSE 0 END) OVER (PARTITION BY source)::DOUBLE AS p
          FROM (SELECT *, words <= wanted AS fits, bool_or(words <= wanted) OVER (PARTITION BY source) AS goes FROM rounds
                WHERE NOT taken AND (step = 0 OR words < 2 * wanted)) WHERE goes))))),
ends AS (SELECT *, max(step) OVER (PARTITION BY source) AS top FROM rounds),
extra AS (SELECT source, doc_id, size FROM ends WHERE step = top AND NOT taken AND abs(words - wanted) < wanted
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(words - wanted), u, doc_id NULLS FIRST, size) = 1),
drawn AS (SELECT source, doc_id, size FROM rounds WHERE taken UNION ALL SELECT * FROM extra)
SELECT f.doc_id, f.size, f.source_size, f.target, ((f.certain + CASE WHEN drawn.size IS NULL THEN 0 ELSE 1 END) * f.size)::BIGINT AS taken
FROM f LEFT JOIN drawn ON f.source IS NOT DISTINCT FROM drawn.source AND f.doc_id IS NOT DISTINCT FROM drawn.doc_id AND f.size = drawn.size
"""


def sharding_sql() -> str:
    """Jump hash as a recursive query; crc32 byte by byte with the table of the reflected polynomial."""
    n = sharding.SHARDS
    step = "((k::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616)::UBIGINT"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS u FROM documents),
poly AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, x:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
t AS (SELECT r, doc_id, octet_length(u)::BIGINT + 1 AS size, xor(4294967295, list_reduce(regexp_extract_all(hex(u), '..'),
  lambda a, x: xor(a >> 8, tab[xor(a & 255, ('0x' || x)::BIGINT) + 1]), 4294967295::BIGINT)) AS text_crc32,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT AS k0 FROM d, poly),
j AS (SELECT r, {step.replace("k::", "k0::")} AS k, 0::BIGINT AS b FROM t
  UNION ALL SELECT r, {step} AS k, floor((b + 1) * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT AS b FROM j
  WHERE floor((b + 1) * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE)) < {n + 1}),
s AS (SELECT r, max(b) FILTER (b < {n})::INT AS shard, max(b)::INT AS grown_shard FROM j GROUP BY r)
SELECT doc_id, size, text_crc32, '{sharding.LAW}' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), doc_id) - 1 AS slot,
  grown_shard FROM t JOIN s USING (r)
"""


def divergence_sql() -> str:
    """The audit written out over terms as strings, with 128-bit integers."""
    p = "1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"
    low = f"translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({low}, '{divergence.TERM_PATTERN}') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lc FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
l AS (SELECT g.lang, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln FROM (SELECT DISTINCT lang FROM d) g
  LEFT JOIN (SELECT lang, count(*)::HUGEINT AS v, sum(lc) AS ln FROM kept GROUP BY lang) k ON g.lang = k.lang),
c AS (SELECT w.lang, source, w.term, count(*)::HUGEINT AS c FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) y ON x.lang = y.lang AND x.source = y.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, {p.format(c="coalesce(c.c, 0)", n="g.n")} AS p, {p.format(c="lc", n="ln")} AS q
  FROM g JOIN l ON g.lang = l.lang JOIN kept ON kept.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= {divergence.RANKS}
"""


def repair_sql() -> str:
    """The edits as a recursive query: each step keeps the least (cost, audit) per conversation and state.

    States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
    """
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    whole = r"regexp_matches(text, '[.!?][\x20\x09-\x0D]*$')"
    return rf"""
WITH RECURSIVE poly AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, x:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'),
  lambda a, x: xor(a >> 8, tab[xor(a & 255, ('0x' || x)::BIGINT) + 1]), 4294967295::BIGINT)) % 20 AS fault FROM conversations, poly),
dmg AS (SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2
  THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE fault <> 0),
num AS (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i,
  row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM dmg),
x AS (SELECT *, {blank} AS blank, {blank} = false AND seen > 1 AS dup, {blank} = false AND seen = 1 AND NOT {whole} AS cut,
  coalesce(lag(ini) OVER (PARTITION BY c ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM num),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 1, 'user:'), (0, 3, 2, 'user:' || chr(10) || 'assistant:'), (1, 1, 0, ''), (1, 2, 1, 'user:'),
  (1, 3, 2, 'user:' || chr(10) || 'assistant:'), (2, 2, 0, ''), (2, 3, 1, 'assistant:'), (3, 3, 0, ''), (3, 2, 1, 'user:')) v(q, t, k, lines)),
best AS (SELECT DISTINCT c, 0::BIGINT AS i, 0 AS q, struct_pack(cost := 0, audit := '', txt := NULL::VARCHAR) AS p FROM src
  UNION ALL
  SELECT c, i, q, min(p) AS p FROM (
    SELECT c, i, e.q AS q, struct_pack(cost := p.cost + 2 * k + e.cost, audit := p.audit || repeat('I', k) || e.letter,
      txt := nullif(concat_ws(chr(10), p.txt, CASE WHEN k > 0 THEN lines END, e.line), '')) AS p
    FROM (SELECT b.c, x.i, b.p, ins.t, ins.k, ins.lines, unnest([
        struct_pack(q := ins.t, cost := 3, letter := 'D', line := NULL::VARCHAR),
        CASE WHEN NOT blank AND NOT dup THEN struct_pack(q := CASE WHEN ins.t = 2 THEN 3 ELSE 2 END, cost := 2 + cut::INT, letter := 'R',
          line := CASE WHEN ins.t = 2 THEN 'assistant:' ELSE 'user:' END || x.text) END,
        CASE WHEN NOT blank AND NOT dup AND (ini = 's' AND ins.t = 0 OR ini = 'u' AND ins.t <> 2 OR ini = 'a' AND ins.t = 2)
          THEN struct_pack(q := CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, cost := cut::INT, letter := 'K', line := x.role || ':' || x.text) END]) AS e
      FROM best b JOIN x ON x.c = b.c AND x.i = b.i + 1 JOIN ins ON ins.q = b.q) WHERE e IS NOT NULL) GROUP BY c, i, q),
n AS (SELECT c, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (illegal) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM x GROUP BY c),
fin AS (SELECT b.c, min(struct_pack(cost := p.cost + 2 * k, audit := p.audit || repeat('I', k), txt := concat_ws(chr(10), p.txt, CASE WHEN k > 0 THEN lines END))) AS p
  FROM best b LEFT JOIN n ON n.c = b.c JOIN ins ON ins.q = b.q WHERE b.i = coalesce(n.n, 0) AND ins.t IN (0, 3) GROUP BY b.c)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, p.cost::BIGINT AS cost, p.audit AS audit, sha256(coalesce(p.txt, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM src) s JOIN fin ON fin.c = s.c LEFT JOIN n ON n.c = s.c
"""


ORACLE = {
    "op3_quality_rules": quality_rules_sql(),
    "op6_mix_sources": mixing_sql(),
    "op11_shard_documents": sharding_sql(),
    "op12_repair_conversations": repair_sql(),
    "op13_source_divergence": divergence_sql(),
}
