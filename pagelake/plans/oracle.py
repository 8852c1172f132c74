"""Independent DuckDB SQL for every registered key.

Each oracle is written from the semantics, not from the Spark plan: spans are
positioned by unnesting split gaps, merged with window functions and
re-assembled with ``string_agg``; folds use recursive CTEs; the graph walk uses
a recursive ``UNION``.  Only base tables are assumed to exist as views.
"""

from __future__ import annotations

from pagelake.functions.text import CATEGORY_PATTERN, LINK_PATTERN, SECTION_PATTERN
from pagelake.plans.views import WIKI_PAGES_SQL

# RE2 (DuckDB) spellings of the mask patterns: '.' already stops only at '\n'.
_MASK_RE2 = [
    r"(?s)<nowiki>.*?</nowiki>",
    r"<!--.*?-->",
    r"(?s)<ref>.*?</ref>",
    r"(?s)<code>.*?</code>",
    r"(?s)<noinclude>.*?</noinclude>",
    r"(?s)<includeonly>.*?</includeonly>",
]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def wiki_cte() -> str:
    return f"wiki_pages AS ({WIKI_PAGES_SQL})"


def masked_ctes(src: str = "wiki_pages", key: str = "page_id", text: str = "text",
                out: str = "masked_pages") -> str:
    """CTEs ending in ``out(key, masked)`` for every row of ``src``."""
    pats = ", ".join(f"({i}, {_q(p)})" for i, p in enumerate(_MASK_RE2))
    return f"""
mask_pat(k, p) AS (VALUES {pats}),
mask_parts AS (
  SELECT s.{key} AS id, string_split_regex(s.{text}, mp.p) AS gs, regexp_extract_all(s.{text}, mp.p) AS ms
  FROM {src} s, mask_pat mp WHERE s.{text} IS NOT NULL),
mask_spans AS (
  SELECT id,
    CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
    CAST(length(ms[i]) AS BIGINT) AS n
  FROM (SELECT id, gs, ms, unnest(generate_series(1, len(ms))) AS i FROM mask_parts WHERE len(ms) > 0)),
mask_ord AS (
  SELECT id, s, s + n AS e,
    max(s + n) OVER (PARTITION BY id ORDER BY s, s + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
  FROM mask_spans),
mask_grp AS (
  SELECT id, s, e, sum(CASE WHEN prev_max IS NULL OR s > prev_max THEN 1 ELSE 0 END)
    OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM mask_ord),
mask_merged AS (SELECT id, min(s) AS s, max(e) AS e FROM mask_grp GROUP BY id, g),
mask_lag AS (
  SELECT m.id, m.s, m.e, coalesce(lag(m.e) OVER (PARTITION BY m.id ORDER BY m.s), 0) AS pe
  FROM mask_merged m),
mask_pieces AS (
  SELECT l.id, l.s AS ord,
    substring(src.{text}, l.pe + 1, l.s - l.pe) || repeat(' ', strlen(substring(src.{text}, l.s + 1, l.e - l.s))) AS piece
  FROM mask_lag l JOIN {src} src ON src.{key} = l.id
  UNION ALL
  SELECT src.{key}, 9223372036854775807,
    substring(src.{text}, coalesce((SELECT max(e) FROM mask_merged mm WHERE mm.id = src.{key}), 0) + 1)
  FROM {src} src),
{out} AS (SELECT id AS {key}, string_agg(piece, '' ORDER BY ord) AS masked FROM mask_pieces GROUP BY id)
"""


def cats_ctes(src: str = "masked_pages", out: str = "page_cats") -> str:
    """CTEs ending in ``out(page_id, cat_pos, category)`` from masked text."""
    return f"""
{out}_raw AS (
  SELECT page_id, list_transform(list_filter(
      list_transform(regexp_extract_all(masked, {_q(CATEGORY_PATTERN)}, 1), lambda c: trim(c, ' ' || chr(13) || chr(10) || chr(9))),
      lambda c: strpos(c, chr(10)) = 0), lambda c: regexp_replace(c, '  +', ' ', 'g')) AS cats
  FROM {src}),
{out} AS (
  SELECT page_id, CAST(unnest(generate_series(1, len(cats))) AS BIGINT) AS cat_pos, unnest(cats) AS category
  FROM {out}_raw WHERE len(cats) > 0)
"""


def content_filter_cte(out: str = "kept_pages") -> str:
    """Pages the category job reads: not a redirect, with text, not Module:/Template:."""
    return f"""{out} AS (
  SELECT * FROM wiki_pages WHERE redirect_title IS NULL AND text IS NOT NULL
    AND NOT starts_with(title, 'Module:') AND NOT starts_with(title, 'Template:'))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["mask_markup"] = with_(wiki_cte(), masked_ctes()) + "SELECT page_id, masked FROM masked_pages"

ORACLE["mask_markup_html"] = with_(masked_ctes(src="pages", key="page_id", text="html")) + \
    "SELECT page_id, masked FROM masked_pages"

ORACLE["extract_categories"] = with_(
    wiki_cte(), content_filter_cte(), masked_ctes(src="kept_pages"), cats_ctes()
) + "SELECT page_id, cat_pos, category FROM page_cats"

ORACLE["category_list"] = with_(
    wiki_cte(), content_filter_cte(), masked_ctes(src="kept_pages"), cats_ctes()
) + "SELECT DISTINCT category FROM page_cats"

ORACLE["category_counts"] = with_(
    wiki_cte(), content_filter_cte(), masked_ctes(src="kept_pages"), cats_ctes()
) + "SELECT category, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages FROM page_cats GROUP BY category"

ORACLE["count_links"] = with_(wiki_cte()) + f"""
SELECT page_id, CAST(coalesce(len(regexp_extract_all(text, {_q(LINK_PATTERN)})), 0) AS BIGINT) AS link_count FROM wiki_pages"""

ORACLE["count_sections"] = with_(wiki_cte()) + f"""
SELECT page_id, CAST(coalesce(len(regexp_extract_all(text, {_q(SECTION_PATTERN)})), 0) AS BIGINT) AS sect_count FROM wiki_pages"""

# ---------------------------------------------------------------- filters / projections
from pagelake.functions.text import XML_BAD_RANGES  # noqa: E402
from pagelake.plans.views import CUSTOMER_FIELDS_SQL, MEDIA_HEADERS_HEX  # noqa: E402

_WS = "' ' || chr(13) || chr(10) || chr(9)"


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def records_cte() -> str:
    nl = "chr(10)"
    return f"""records AS (
  SELECT page_id,
    '  <page>' || {nl} || '    <title>' || {_esc('title')} || '</title>' || {nl} || '    <ns>0</ns>' || {nl} ||
    '    <id>' || CAST(page_id AS VARCHAR) || '</id>' || {nl} ||
    coalesce('    <redirect title="' || {_esc('redirect_title')} || '" />' || {nl}, '') ||
    '    <revision>' || {nl} || '      <id>' || CAST(page_id AS VARCHAR) || '</id>' || {nl} ||
    '      <timestamp>2024-06-01T00:00:00Z</timestamp>' || {nl} ||
    CASE WHEN text IS NULL THEN '      <text bytes="0" />' || {nl}
      ELSE '      <text bytes="' || CAST(strlen(text) AS VARCHAR) || '" xml:space="preserve">' || {_esc('text')} || '</text>' || {nl} END ||
    '    </revision>' || {nl} || '  </page>' || {nl} AS record
  FROM wiki_pages)"""


def customer_cte() -> str:
    return f"customer_fields AS ({CUSTOMER_FIELDS_SQL})"


ORACLE["flt_not_redirect"] = with_(wiki_cte()) + "SELECT page_id, title FROM wiki_pages WHERE redirect_title IS NULL"
ORACLE["flt_has_text"] = with_(wiki_cte()) + "SELECT page_id, title FROM wiki_pages WHERE page_id % 17 <> 3"
ORACLE["flt_namespace"] = with_(wiki_cte()) + """SELECT page_id, title FROM wiki_pages
WHERE NOT starts_with(title, 'Module:') AND NOT starts_with(title, 'Template:')"""

_PAGE_TYPE_SQL = """CASE WHEN redirect_title IS NOT NULL THEN 'redirect'
  WHEN starts_with(title, 'Module:') THEN 'module' WHEN starts_with(title, 'Template:') THEN 'template'
  WHEN starts_with(title, 'Portal:') THEN 'portals' WHEN starts_with(title, 'Category:') THEN 'categories'
  WHEN starts_with(title, 'Help:') THEN 'help' WHEN starts_with(title, 'Wikipedia:') THEN 'wikipedia'
  ELSE 'article' END"""

ORACLE["prj_page_type"] = with_(wiki_cte()) + f"SELECT page_id, {_PAGE_TYPE_SQL} AS page_type FROM wiki_pages"

ORACLE["page_link_stats"] = with_(wiki_cte()) + f"""
SELECT {_PAGE_TYPE_SQL} AS page_type, CAST(count(*) AS BIGINT) AS n_pages,
  CAST(sum(coalesce(len(regexp_extract_all(text, {_q(LINK_PATTERN)})), 0)) AS BIGINT) AS link_count,
  CAST(sum(coalesce(len(regexp_extract_all(text, {_q(SECTION_PATTERN)})), 0)) AS BIGINT) AS sect_count
FROM wiki_pages GROUP BY 1"""

_RAW_GROUPS = f"""raw_groups AS (
  SELECT page_id, CAST(unnest(generate_series(1, len(g))) AS BIGINT) AS cat_pos, unnest(g) AS raw
  FROM (SELECT page_id, regexp_extract_all(text, {_q(CATEGORY_PATTERN)}, 1) AS g FROM wiki_pages))"""

ORACLE["trim_ws"] = with_(wiki_cte(), _RAW_GROUPS) + f"SELECT page_id, cat_pos, trim(raw, {_WS}) AS trimmed FROM raw_groups"
ORACLE["collapse_spaces"] = with_(wiki_cte(), _RAW_GROUPS) + \
    "SELECT page_id, cat_pos, regexp_replace(raw, '  +', ' ', 'g') AS collapsed FROM raw_groups"

# from the record frame, not from the record text: a page has a redirect or not, and a text or not
ORACLE["page_layout"] = with_(wiki_cte()) + """
SELECT DISTINCT '<page><title></title><ns></ns><id></id>' ||
  CASE WHEN redirect_title IS NULL THEN '' ELSE '<redirect title/>' END ||
  '<revision><id></id><timestamp></timestamp>' ||
  CASE WHEN text IS NULL THEN '<text bytes/>' ELSE '<text bytes xml:space></text>' END || '</revision></page>' AS layout
FROM wiki_pages"""
# from the rule: after comments and entities are gone, no markup and no ampersand may be left
ORACLE["xml_validate"] = with_(wiki_cte()) + """
SELECT page_id, NOT regexp_matches(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'),
  '&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);', '', 'g'), '[<&]') AS is_valid FROM wiki_pages"""

ORACLE["src_pages"] = with_(wiki_cte(), records_cte()) + """
SELECT page_id, title, redirect_title, text, NULL AS reject, NULL AS record FROM wiki_pages WHERE page_id % 97 NOT IN (13, 29, 31)
UNION ALL
SELECT -1, NULL, NULL, NULL, CASE WHEN page_id % 97 = 31 THEN 'no id' ELSE 'malformed' END,
  rtrim(ltrim(CASE page_id % 97 WHEN 13 THEN replace(record, '</revision>', '</revision') WHEN 29 THEN replace(record, '<ns>', '& <ns>')
    ELSE replace(record, '    <id>' || CAST(page_id AS VARCHAR) || '</id>' || chr(10), '    ' || chr(10)) END, ' '), chr(10))
FROM records WHERE page_id % 97 IN (13, 29, 31)"""
ORACLE["page_to_json"] = with_(wiki_cte()) + """
SELECT page_id, CAST(to_json({'page_id': page_id, 'title': title, 'redirect_title': redirect_title, 'text': text}) AS VARCHAR) AS json
FROM wiki_pages"""
ORACLE["page_json_by_id"] = ORACLE["page_to_json"] + " WHERE page_id IN (SELECT doc_id FROM labels)"
ORACLE["point_lookup_page"] = with_(wiki_cte()) + "SELECT page_id, title, text FROM wiki_pages WHERE page_id = 777"
ORACLE["random_sample_n"] = with_(wiki_cte()) + """
SELECT page_id FROM wiki_pages ORDER BY md5('s42:' || CAST(page_id AS VARCHAR)) LIMIT 40"""

_BAD_RE2 = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in XML_BAD_RANGES) + "]"
ORACLE["xml_scrub"] = f"""SELECT doc_id, regexp_replace(CASE WHEN doc_id % 7 = 2
  THEN text || chr(1) || 'a' || chr(11) || chr(65534) || 'b' || chr(9) ELSE text END, {_q(_BAD_RE2)}, '�', 'g') AS scrubbed FROM documents"""

ORACLE["str_translate"] = "SELECT c_custkey, translate(c_name, '0123456789#', 'abcdefghij-') AS translated FROM customer"
ORACLE["sha256_hex"] = "SELECT c_custkey, sha256(c_name) AS name_sha256 FROM customer"
ORACLE["flt_account_name"] = with_(customer_cte()) + """
SELECT c_custkey, username FROM customer_fields
WHERE length(username) <= 20 AND regexp_matches(username, '^[a-zA-Z0-9_.-]*\\n?$')"""
ORACLE["flt_mail"] = with_(customer_cte()) + """
SELECT c_custkey, mail FROM customer_fields
WHERE length(mail) <= 50 AND regexp_full_match(mail, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,7}\\b')"""
ORACLE["flt_phone"] = with_(customer_cte()) + """
SELECT c_custkey, phone FROM customer_fields WHERE length(phone) <= 16 AND regexp_full_match(phone, '\\+[0-9]*')"""

_URL_RE2 = (r"(?i)^(?:http|ftp)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
            r"localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$")
ORACLE["prj_url_norm"] = f"""
WITH hrefs AS (
  SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), '') AS origin,
    CAST(unnest(generate_series(1, len(h))) AS BIGINT) AS href_pos, unnest(h) AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)
  UNION ALL
  SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), ''), 0, url FROM pages
  UNION ALL
  SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), ''), -1 - page_id % 6,
    CASE page_id % 6 WHEN 0 THEN 'javascript:void(0)' WHEN 1 THEN 'mailto:a@b.example' WHEN 2 THEN '//cdn.example.org/x y'
      WHEN 3 THEN '//cdn.example.org/x' WHEN 4 THEN 'https://-bad-.example/' ELSE '' END FROM pages),
full_urls AS (
  SELECT *, CASE WHEN starts_with(href, '//') THEN 'https:' || href
                 WHEN starts_with(href, '/') THEN origin || href ELSE href END AS full_url FROM hrefs)
SELECT page_id, href_pos, href, CASE WHEN regexp_matches(full_url, {_q(_URL_RE2)}) THEN full_url END AS url_norm
FROM full_urls"""

_HDR_CASE = f"CASE doc_id % {len(MEDIA_HEADERS_HEX)} " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(MEDIA_HEADERS_HEX)) + " END"
_MEDIA_CTE = f"""blobs AS (SELECT doc_id, unhex({_HDR_CASE}) || encode(text) AS content FROM documents),
typed AS (
  SELECT doc_id, content, hex(content) AS h FROM blobs),
classified AS (
  SELECT doc_id, content, CASE
    WHEN substr(h, 13, 8) IN ('4A464946', '45786966') OR starts_with(h, 'FFD8FF') THEN 'jpeg'
    WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png'
    WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'gif'
    WHEN starts_with(h, '4D4D') OR starts_with(h, '4949') THEN 'tiff'
    WHEN starts_with(h, '01DA') THEN 'rgb'
    WHEN substr(h, 1, 4) IN ('5031', '5034') AND substr(h, 5, 2) IN ('20', '09', '0A', '0D') THEN 'pbm'
    WHEN substr(h, 1, 4) IN ('5032', '5035') AND substr(h, 5, 2) IN ('20', '09', '0A', '0D') THEN 'pgm'
    WHEN substr(h, 1, 4) IN ('5033', '5036') AND substr(h, 5, 2) IN ('20', '09', '0A', '0D') THEN 'ppm'
    WHEN starts_with(h, '59A66A95') THEN 'rast'
    WHEN starts_with(h, '23646566696E6520') THEN 'xbm'
    WHEN starts_with(h, '424D') THEN 'bmp'
    WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp'
    WHEN starts_with(h, '762F3101') THEN 'exr' END AS media_type
  FROM typed)"""
ORACLE["src_media_type"] = with_(_MEDIA_CTE) + "SELECT doc_id, media_type FROM classified"
ORACLE["media_profile"] = with_(_MEDIA_CTE) + """
SELECT media_type, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(octet_length(content)) AS BIGINT) AS total_bytes
FROM classified GROUP BY media_type"""

# ---------------------------------------------------------------- dump index, streams, chunks


def index_ctes() -> str:
    return """
streams AS (SELECT CAST(floor(doc_id / 100) AS BIGINT) AS stream, CAST(sum(n_chars) AS BIGINT) AS stream_bytes
  FROM documents GROUP BY 1),
soff AS (SELECT stream, CAST(550 + coalesce(sum(stream_bytes) OVER (ORDER BY stream ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM streams),
flen AS (SELECT CAST(550 + sum(n_chars) AS BIGINT) AS file_len FROM documents),
idx AS (SELECT s."offset", w.page_id, w.title FROM wiki_pages w JOIN soff s ON CAST(floor(w.page_id / 100) AS BIGINT) = s.stream),
ranges AS (SELECT "offset" AS st, CAST(coalesce(lead("offset") OVER (ORDER BY "offset"), (SELECT file_len FROM flen)) AS BIGINT) AS ed
  FROM (SELECT DISTINCT "offset" FROM idx))
"""


_IX = with_(wiki_cte(), index_ctes())
_BAD_LINES = """, bad_lines AS (
  SELECT 'bad offset' AS reject, 'x:' || page_id || ':' || title AS record FROM wiki_pages WHERE page_id % 89 = 3
  UNION ALL SELECT 'bad id', '550:K:' || page_id FROM wiki_pages WHERE page_id % 89 = 5
  UNION ALL SELECT 'no title', '550:' || page_id FROM wiki_pages WHERE page_id % 89 = 7)
"""
ORACLE["src_dump_index"] = _IX.rstrip() + _BAD_LINES + """SELECT "offset", page_id, title, NULL AS record, NULL AS reject FROM idx
UNION ALL SELECT -1, -1, NULL, record, reject FROM bad_lines"""
ORACLE["line_count"] = _IX.rstrip() + _BAD_LINES + """SELECT CAST((SELECT count(*) FROM idx) + (SELECT count(*) FROM bad_lines) AS BIGINT) AS n_lines,
  CAST((SELECT count(*) FROM bad_lines) AS BIGINT) AS n_rejects"""
ORACLE["sort_offsets"] = _IX + 'SELECT DISTINCT "offset" FROM idx ORDER BY 1'
ORACLE["stream_ranges"] = _IX + "SELECT st, ed FROM ranges"
ORACLE["grp_pages_by_stream"] = _IX + """SELECT "offset", CAST(count(*) AS BIGINT) AS n_pages,
  string_agg(CAST(page_id AS VARCHAR) || ' ' || title, chr(10) ORDER BY page_id) AS pages FROM idx GROUP BY "offset" """
ORACLE["stream_pack_bytes"] = _IX + """,
walk AS (
  SELECT (SELECT min(st) FROM ranges) AS base
  UNION ALL
  SELECT (SELECT min(r.ed) FROM ranges r WHERE r.ed > w.base + 500000) FROM walk w WHERE w.base IS NOT NULL)
SELECT r.st, r.ed, r.st IN (SELECT base FROM walk WHERE base IS NOT NULL) AS pack_start FROM ranges r"""
ORACLE["stream_pack_bytes"] = ORACLE["stream_pack_bytes"].replace("WITH ", "WITH RECURSIVE ", 1)
# the same faults as in the derived dump, each flag computed from them
_VALIDATE = with_(wiki_cte(), index_ctes()).rstrip() + """,
stored AS (SELECT page_id, title, page_id % 97 <> 13 AS xml_ok FROM wiki_pages WHERE page_id % 97 <> 5),
indexed AS (SELECT "offset", CASE WHEN page_id % 97 = 11 THEN page_id + 1000000007 ELSE page_id END AS page_id,
    CASE WHEN page_id % 97 = 9 THEN 'not ' || title ELSE title END AS title
  FROM idx WHERE page_id % 97 <> 7),
checks AS (
  SELECT coalesce(i."offset", -1) AS "offset", i.page_id IS NOT NULL AS indexed, s.page_id IS NOT NULL AS stored,
    i.page_id IS NOT NULL AND s.page_id IS NOT NULL AND s.xml_ok AS id_ok,
    coalesce(trim(i.title) = trim(s.title), false) AND coalesce(s.xml_ok, false) AS title_ok, coalesce(s.xml_ok, false) AS xml_ok
  FROM indexed i FULL JOIN stored s ON s.page_id = i.page_id),
report AS (
  SELECT "offset", CAST(count(*) FILTER (indexed) AS BIGINT) AS n_indexed, CAST(count(*) FILTER (stored) AS BIGINT) AS n_stored,
    bool_and(id_ok) AS ids_ok, bool_and(title_ok) AS titles_ok, bool_and(xml_ok) AS xml_ok,
    bool_and(id_ok AND title_ok AND xml_ok) AS valid
  FROM checks GROUP BY "offset")
"""
ORACLE["validate_index"] = _VALIDATE + "SELECT * FROM report"
ORACLE["all_valid"] = _VALIDATE + "SELECT bool_and(valid) AS all_valid, CAST(count(*) AS BIGINT) AS n_streams FROM report"

# ---------------------------------------------------------------- category index and graph


def cat_index_ctes() -> str:
    """Lower-cased category index built straight from the extracted categories."""
    return """
cat_lists AS (
  SELECT k.page_id, lower(k.title) AS title,
    coalesce(list_filter((SELECT list(lower(pc.category) ORDER BY pc.cat_pos) FROM page_cats pc WHERE pc.page_id = k.page_id),
      lambda c: c <> ''), []) AS cats
  FROM kept_pages k),
cat_graph AS (SELECT page_id, substr(title, 10) AS title, cats FROM cat_lists
  WHERE starts_with(title, 'category:') AND len(cats) > 0),
cat_edges AS (SELECT page_id, title, unnest(cats) AS parent FROM cat_graph),
walk(title, depth) AS (
  SELECT DISTINCT title, 0 FROM cat_edges WHERE parent = 'k0'
  UNION
  SELECT e.title, w.depth + 1 FROM walk w JOIN cat_edges e ON e.parent = w.title
  WHERE w.depth < (SELECT count(*) FROM cat_graph) AND e.title <> 'k0'),
levels AS (SELECT CAST(min(depth) AS BIGINT) AS level, title FROM walk GROUP BY title),
level_rows AS (SELECT l.level, c.page_id, c.title FROM levels l JOIN cat_graph c ON c.title = l.title),
seen AS (SELECT title FROM levels UNION SELECT 'k0')
"""


_CG = "WITH RECURSIVE " + with_(wiki_cte(), content_filter_cte(), masked_ctes(src="kept_pages"), cats_ctes(),
                                cat_index_ctes())[len("WITH "):]
ORACLE["src_category_index"] = _CG + """SELECT page_id, title, CAST(len(cats) AS BIGINT) AS n_cats,
  array_to_string(cats, '|') AS cats, NULL AS reject, NULL AS record FROM cat_lists
UNION ALL SELECT -1, NULL, -1, NULL, CASE page_id % 83 WHEN 0 THEN 'bad id' ELSE 'no title' END,
  CASE page_id % 83 WHEN 0 THEN 'no id|' || title ELSE CAST(page_id AS VARCHAR) END FROM wiki_pages WHERE page_id % 83 < 2"""
ORACLE["prj_category_pages"] = _CG + "SELECT page_id, title, array_to_string(cats, '|') AS cats FROM cat_graph"
ORACLE["prj_content_pages"] = _CG + """SELECT page_id, title, array_to_string(cats, '|') AS cats FROM cat_lists
WHERE NOT regexp_matches(title, '^(category|module|template|portal|help):') AND len(cats) > 0"""
ORACLE["join_parent_category"] = _CG + """SELECT DISTINCT n.page_id, g.page_id AS parent_id
FROM (SELECT page_id, unnest(cats) AS name FROM cat_lists) n JOIN cat_graph g ON g.title = n.name"""
ORACLE["category_descendants"] = _CG + "SELECT level, page_id, title FROM level_rows"
ORACLE["level_counts"] = _CG + """SELECT CAST(CASE WHEN grouping(level) = 1 THEN -1 ELSE level END AS BIGINT) AS level,
  CAST(count(*) AS BIGINT) AS n_rows FROM level_rows GROUP BY ROLLUP (level)"""
ORACLE["max_title_length"] = _CG + "SELECT CAST(max(strlen(title)) AS BIGINT) AS max_title_bytes FROM cat_graph"
ORACLE["set_union_seen"] = _CG + "SELECT title FROM seen"
ORACLE["set_difference_seen"] = _CG + "SELECT DISTINCT title FROM cat_graph WHERE title NOT IN (SELECT title FROM seen)"
ORACLE["pages_under_category"] = _CG + """SELECT DISTINCT page_id, title FROM (
  SELECT page_id, title, unnest(cats) AS name FROM cat_lists
  WHERE NOT regexp_matches(title, '^(category|module|template|portal|help):') AND len(cats) > 0)
WHERE name IN (SELECT title FROM seen)"""
ORACLE["sink_category_index"] = _CG + """SELECT CAST(k.page_id AS VARCHAR) || '|' || k.title || '|' ||
  coalesce((SELECT string_agg(pc.category, '|' ORDER BY pc.cat_pos) FROM page_cats pc WHERE pc.page_id = k.page_id), '') AS value
FROM kept_pages k"""
ORACLE["sink_category_list"] = _CG + "SELECT DISTINCT category FROM page_cats"
ORACLE["sink_category_table"] = _CG + "SELECT page_id, title AS category FROM cat_graph"

# ---------------------------------------------------------------- ledger jobs
from pagelake.plans.views import LEDGER_SQL  # noqa: E402

_NAME_OK = "(length({c}) <= 20 AND regexp_matches({c}, '^[a-zA-Z0-9_.-]*\\n?$'))"


def _network(x: str) -> str:
    """The permutation of a draw: two halves, each changed twice by a mix of the other."""
    def mix(half: str, key: int) -> str:
        v = f"(({half} + ks[{key}]) % 2147483647)"
        return f"({v} * {v} % 2147483647 * 48271 % 2147483647)"

    high, rest = f"({x} >> lb)", f"({x} & lm)"
    for turn in (1, 3):
        high = f"xor({high}, {mix(rest, turn)} & hm)"
        rest = f"xor({rest}, {mix(high, turn + 1)} & lm)"
    return f"(({high} << lb) | {rest})"


def ledger_ctes() -> str:
    views = ",\n".join(f"{name} AS ({sql})" for name, sql in LEDGER_SQL.items())
    return _ledger_rules(views).replace("{feistel0}", _network("k")).replace("{feistel1}", _network("rnk"))


def _ledger_rules(views: str) -> str:
    return views + """,
balances AS (
  SELECT p.account_id, p.ranks, CAST(p.balance + coalesce(c.s, 0) AS BIGINT) AS balance, p.pull_count
  FROM profiles p LEFT JOIN (SELECT account_id, sum(amount) AS s FROM credits GROUP BY account_id) c
    ON c.account_id = p.account_id),
-- the planted claims decided by hand, level by level of the log: p_next is the part whose first name is asked for,
-- p_prev the one that may have taken it
parts AS (SELECT p_partkey AS k, p_size AS size, p_name || '#' || p_partkey AS first_name, p_brand || '#' || p_partkey AS late_name FROM part),
turns AS (SELECT a.*, n.first_name AS next_name, a.size IN (44, 45) AND coalesce(n.size > 45, false) AS moved_on,
    a.size > 45 AND coalesce(b.size IN (44, 45), false) AS lost
  FROM parts a LEFT JOIN parts n ON n.k = a.k + 1 LEFT JOIN parts b ON b.k = a.k - 1),
held AS (
  SELECT k AS item_id, first_name AS item_name, 0 AS st, CASE WHEN size > 45 THEN 3 WHEN moved_on THEN 4 ELSE 1000 END AS ed FROM turns
  UNION ALL SELECT k, late_name, 3, CASE WHEN size > 47 AND NOT lost THEN 5 ELSE 1000 END FROM turns WHERE size > 45
  UNION ALL SELECT k, next_name, 4, 1000 FROM turns WHERE moved_on
  UNION ALL SELECT k, first_name, 5, 1000 FROM turns WHERE size > 47 AND NOT lost
  UNION ALL SELECT k + 2000000, first_name, 8, 1000 FROM turns WHERE size = 46 AND NOT lost),
cat AS (
  SELECT h.item_id, h.item_name, CASE WHEN t.size % 7 = 0 THEN 'yanked' ELSE 'live' END AS item_stat
  FROM held h LEFT JOIN parts t ON t.k = h.item_id WHERE h.ed = 1000),
cat_bad AS (
  SELECT l.seq, l.op, l.item_id, l.item_name, CASE WHEN l.seq = 6 THEN 'invalid id' ELSE 'name exists' END AS status
  FROM catalog_log l LEFT JOIN turns t ON t.k = l.item_id % 1000000
  WHERE l.seq IN (1, 6) OR (l.seq = 4 AND NOT t.moved_on) OR (l.seq = 5 AND t.lost) OR (l.seq = 8 AND (t.size = 49 OR t.lost))),
born AS (SELECT item_id, min(st) AS born FROM held GROUP BY item_id),
shop_chk AS (
  SELECT l.seq, l.op, l.item_id AS asked_id, l.item_name AS asked_name, c.item_id AS rid, l.item_cost,
    CASE WHEN c.item_id IS NULL THEN NULL WHEN l.seq >= 2 AND t.size % 7 = 0 THEN 'yanked' ELSE 'live' END AS item_stat
  FROM shop_log l LEFT JOIN held n ON l.item_id IS NULL AND n.item_name = l.item_name AND n.st <= l.seq AND l.seq < n.ed
  LEFT JOIN born c ON c.item_id = coalesce(l.item_id, n.item_id) AND c.born <= l.seq
  LEFT JOIN parts t ON t.k = c.item_id),
shop_ok AS (SELECT * FROM shop_chk WHERE item_stat IS NOT NULL AND NOT (op = 'list' AND item_stat = 'yanked')),
shop_seq AS (
  SELECT *, lag(op) OVER (PARTITION BY rid ORDER BY seq, op) AS prev_op FROM shop_ok),
offers AS (
  SELECT rid, seq AS st, lead(seq, 1, 1000) OVER (PARTITION BY rid ORDER BY seq, op) AS ed, op, item_cost
  FROM shop_seq WHERE NOT (op = 'list' AND coalesce(prev_op, '') = 'list')),
shop AS (SELECT rid AS item_id, item_cost FROM offers WHERE ed = 1000 AND op = 'list'),
p_checked AS (
  SELECT q.request_id, q.account_id, coalesce(q.item_id, c.item_id, -1) AS item_id, q.item_name, q.item_count,
    CASE WHEN b.account_id IS NULL THEN 'invalid name'
         WHEN c.item_id IS NULL OR o.item_cost IS NULL THEN CASE WHEN q.item_id IS NULL THEN 'invalid name' ELSE 'invalid id' END
         WHEN q.seq >= 2 AND t.size % 7 = 0 THEN 'bad status' WHEN q.item_count <= 0 THEN 'invalid count' END AS status,
    o.item_cost * q.item_count AS cost
  FROM purchases q LEFT JOIN balances b ON b.account_id = q.account_id
  LEFT JOIN held n ON q.item_id IS NULL AND n.item_name = q.item_name AND n.st <= q.seq AND q.seq < n.ed
  LEFT JOIN born c ON c.item_id = coalesce(q.item_id, n.item_id) AND c.born <= q.seq
  LEFT JOIN parts t ON t.k = c.item_id
  LEFT JOIN offers o ON o.rid = c.item_id AND o.st <= q.seq AND q.seq < o.ed AND o.op = 'list'),
p_valid AS (
  SELECT account_id, request_id, cost, row_number() OVER (PARTITION BY account_id ORDER BY request_id) AS rn
  FROM p_checked WHERE status IS NULL),
p_fold(account_id, rn, bal, ok) AS (
  SELECT v.account_id, v.rn, CASE WHEN v.cost <= b.balance THEN b.balance - v.cost ELSE b.balance END, v.cost <= b.balance
  FROM p_valid v JOIN balances b ON b.account_id = v.account_id WHERE v.rn = 1
  UNION ALL
  SELECT v.account_id, v.rn, CASE WHEN v.cost <= f.bal THEN f.bal - v.cost ELSE f.bal END, v.cost <= f.bal
  FROM p_fold f JOIN p_valid v ON v.account_id = f.account_id AND v.rn = f.rn + 1),
p_result AS (
  SELECT c.request_id, c.account_id, c.item_id, c.item_name, c.item_count, c.cost,
    coalesce(c.status, CASE WHEN f.ok THEN 'ok' ELSE 'insufficient balance' END) AS status
  FROM p_checked c LEFT JOIN p_valid v ON v.request_id = c.request_id
  LEFT JOIN p_fold f ON f.account_id = v.account_id AND f.rn = v.rn),
d_checked AS (
  SELECT q.request_id, q.account_id, q.amount,
    CASE WHEN b.account_id IS NULL THEN 'invalid name' WHEN q.amount <= 0 THEN 'invalid count' END AS status
  FROM draws q LEFT JOIN balances b ON b.account_id = q.account_id),
d_valid AS (
  SELECT account_id, request_id, amount, row_number() OVER (PARTITION BY account_id ORDER BY request_id) AS rn
  FROM d_checked WHERE status IS NULL),
d_fold(account_id, rn, bal, ok) AS (
  SELECT v.account_id, v.rn, CASE WHEN v.amount <= b.balance THEN b.balance - v.amount ELSE b.balance END, v.amount <= b.balance
  FROM d_valid v JOIN balances b ON b.account_id = v.account_id WHERE v.rn = 1
  UNION ALL
  SELECT v.account_id, v.rn, CASE WHEN v.amount <= f.bal THEN f.bal - v.amount ELSE f.bal END, v.amount <= f.bal
  FROM d_fold f JOIN d_valid v ON v.account_id = f.account_id AND v.rn = f.rn + 1),
d_result AS (
  SELECT c.request_id, c.account_id, c.amount,
    coalesce(c.status, CASE WHEN f.ok THEN 'ok' ELSE 'insufficient balance' END) AS status
  FROM d_checked c LEFT JOIN d_valid v ON v.request_id = c.request_id
  LEFT JOIN d_fold f ON f.account_id = v.account_id AND f.rn = v.rn),
n_pages AS (SELECT count(*) AS n FROM wiki_pages),
ranked AS (
  SELECT page_id, row_number() OVER (ORDER BY substr(md5('draw42:' || CAST(page_id AS VARCHAR)), 1, 15), page_id) - 1 AS rnk
  FROM wiki_pages),
d_bits AS (SELECT n, b // 2 AS hb, b - b // 2 AS lb FROM (SELECT n, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END AS b FROM n_pages)),
d_rank AS MATERIALIZED (
  SELECT request_id, account_id, n, hb, lb, (1 << hb) - 1 AS hm, (1 << lb) - 1 AS lm, unnest(range(least(amount, n))) AS k,
    [('0x' || substr(md5('draw42:k' || i || ':' || request_id), 1, 15))::BIGINT % 2147483647 FOR i IN range(4)] AS ks
  FROM d_result, d_bits WHERE status = 'ok'),
d_walk(request_id, account_id, n, hb, lb, hm, lm, ks, rnk) AS (
  SELECT request_id, account_id, n, hb, lb, hm, lm, ks, {feistel0} FROM d_rank
  UNION ALL
  SELECT request_id, account_id, n, hb, lb, hm, lm, ks, {feistel1} FROM d_walk WHERE rnk >= n),
d_pages AS (
  SELECT w.request_id, w.account_id, r.page_id FROM d_walk w JOIN ranked r ON r.rnk = w.rnk WHERE w.rnk < w.n),
coll_after AS (SELECT account_id, page_id FROM collection UNION SELECT account_id, page_id FROM d_pages),
d_profiles AS (
  SELECT b.account_id, b.ranks,
    CAST(b.balance - coalesce(s.spent, 0) AS BIGINT) AS balance, CAST(b.pull_count + coalesce(s.spent, 0) AS BIGINT) AS pull_count
  FROM balances b LEFT JOIN (SELECT account_id, sum(amount) AS spent FROM d_result WHERE status = 'ok' GROUP BY 1) s
    ON s.account_id = b.account_id)
"""


_LG = "WITH RECURSIVE " + with_(wiki_cte(), ledger_ctes())[len("WITH "):]
ORACLE["ledger_balance"] = _LG + "SELECT account_id, balance FROM balances"
ORACLE["catalog_upsert"] = _LG + "SELECT item_id, item_name, item_stat FROM cat"
ORACLE["catalog_rejects"] = _LG + "SELECT seq, op, item_id, item_name, status FROM cat_bad"
ORACLE["shop_listing"] = _LG + "SELECT item_id, item_cost FROM shop"
ORACLE["shop_rejects"] = _LG + """SELECT seq, op, coalesce(CAST(asked_id AS VARCHAR), asked_name) AS item,
  CASE WHEN item_stat IS NULL AND asked_id IS NULL THEN 'invalid name' WHEN item_stat IS NULL THEN 'invalid id'
       ELSE 'bad status' END AS status
FROM shop_chk WHERE item_stat IS NULL OR (op = 'list' AND item_stat = 'yanked')
UNION ALL
SELECT seq, op, coalesce(CAST(asked_id AS VARCHAR), asked_name), 'duplicate' FROM shop_seq WHERE op = 'list' AND prev_op = 'list'"""
ORACLE["join_catalog"] = _LG + "SELECT c.item_id, c.item_name, c.item_stat, s.item_cost FROM cat c JOIN shop s ON s.item_id = c.item_id"
ORACLE["flt_item_status"] = _LG + "SELECT item_id, item_name FROM cat WHERE item_stat <> 'yanked'"
ORACLE["ledger_purchase"] = _LG + "SELECT request_id, account_id, item_id, item_name, item_count, status FROM p_result"
ORACLE["ledger_purchase_balance"] = _LG + """SELECT b.account_id, CAST(b.balance - coalesce(s.spent, 0) AS BIGINT) AS balance
FROM balances b LEFT JOIN (SELECT account_id, sum(cost) AS spent FROM p_result WHERE status = 'ok' GROUP BY 1) s
  ON s.account_id = b.account_id"""
ORACLE["storage_upsert"] = _LG + """SELECT account_id, item_id, CAST(sum(item_count) AS BIGINT) AS item_count FROM (
  SELECT account_id, item_id, item_count FROM storage
  UNION ALL SELECT account_id, item_id, item_count FROM p_result WHERE status = 'ok') GROUP BY account_id, item_id"""
ORACLE["ledger_draw"] = _LG + "SELECT request_id, account_id, amount, status FROM d_result"
ORACLE["ledger_draw_pages"] = _LG + "SELECT request_id, account_id, page_id FROM d_pages"
ORACLE["insert_ignore"] = _LG + "SELECT account_id, page_id FROM coll_after"
ORACLE["ledger_relation"] = _LG + """, rel_res AS (
  SELECT r.request_id, a.account_id AS src_id, b.account_id AS dst_id FROM relation_requests r
  LEFT JOIN accounts a ON a.username = r.src_name LEFT JOIN accounts b ON b.username = r.dst_name),
rel_good AS (
  SELECT request_id, least(src_id, dst_id) AS id0, greatest(src_id, dst_id) AS id1, src_id < dst_id AS src_0
  FROM rel_res WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)
SELECT id0, id1, src_0, 'pending' AS status, request_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id0, id1 ORDER BY request_id) AS rn FROM rel_good) WHERE rn = 1"""
_REG_VALID = (_NAME_OK.format(c="r.username") + " AND " + _NAME_OK.format(c="r.display_name") +
              " AND length(r.mail) <= 50 AND regexp_full_match(r.mail, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,7}\\b')"
              " AND (r.phone IS NULL OR (length(r.phone) <= 16 AND regexp_full_match(r.phone, '\\+[0-9]*')))")
_LOCAL, _GLOBAL = (f"(SELECT strip_accents(lower(username)) FROM {t})" for t in ("existing_local", "existing_global"))
ORACLE["register_batch"] = _LG + f""", reg_valid AS (
  SELECT r.*, strip_accents(lower(r.username)) AS same, ({_REG_VALID}) AS is_valid FROM registrations r),
reg AS (
  SELECT r.req_id, r.username, r.same,
    CASE WHEN NOT r.is_valid THEN 'invalid'
         WHEN r.same IN {_LOCAL} THEN 'account exists'
         WHEN r.req_id <> (SELECT min(r2.req_id) FROM reg_valid r2 WHERE r2.same = r.same AND r2.is_valid) THEN 'duplicate'
         ELSE 'ok' END AS status
  FROM reg_valid r)
SELECT req_id, username, status, (status = 'ok' AND same IN {_GLOBAL}) AS uni_reused FROM reg"""
ORACLE["exists_lookup"] = _LG + f"""SELECT req_id, username, strip_accents(lower(username)) IN {_LOCAL} AS local_taken,
  strip_accents(lower(username)) IN {_GLOBAL} AS global_known FROM registrations"""
ORACLE["profile_defaults"] = _LG + """SELECT a.account_id, coalesce(p.ranks, 0) AS ranks, coalesce(p.balance, 0) AS balance,
  coalesce(p.pull_count, 0) AS pull_count, p.account_id IS NULL AS created, coalesce(i.description, '') AS description
FROM accounts a LEFT JOIN profiles p ON p.account_id = a.account_id LEFT JOIN intros i ON i.account_id = a.account_id"""
ORACLE["join_account"] = _LG + """SELECT a.account_id, a.uni_id, a.username, a.acc_status, u.mail, u.uni_status
FROM accounts a JOIN uni_accounts u ON u.uni_id = a.uni_id"""
ORACLE["flt_account_live"] = _LG + """SELECT a.account_id FROM accounts a JOIN uni_accounts u ON u.uni_id = a.uni_id
WHERE a.acc_status = 'live' AND u.uni_status = 'live'"""
ORACLE["join_user_info"] = _LG + """SELECT a.account_id, a.username, u.mail, p.balance, p.pull_count, p.ranks, i.description
FROM accounts a JOIN uni_accounts u ON u.uni_id = a.uni_id JOIN profiles p ON p.account_id = a.account_id
JOIN intros i ON i.account_id = a.account_id"""
ORACLE["user_info"] = _LG + """SELECT a.account_id, a.username, p.balance, p.pull_count, coalesce(c.page_id, -1) AS page_id
FROM accounts a JOIN uni_accounts u ON u.uni_id = a.uni_id JOIN d_profiles p ON p.account_id = a.account_id
JOIN intros i ON i.account_id = a.account_id LEFT JOIN coll_after c ON c.account_id = a.account_id"""

# ---------------------------------------------------------------- history, site info, stores
from pagelake.plans.views import SITE_HEADER_SQL  # noqa: E402

_HIST = """hist AS (
  SELECT o_custkey AS page_id, o_orderkey AS rev_id, CAST(epoch(o_orderdate) AS BIGINT) AS epoch,
    CAST(floor(o_totalprice) AS BIGINT) AS bytes,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rev_pos,
    CASE WHEN o_orderkey % 103 = 5 THEN 'malformed' WHEN o_orderkey % 101 = 7 THEN 'bad timestamp'
      WHEN o_custkey % 211 = 3 THEN 'bad page' END AS reject,
    '<revision><id>' || o_orderkey || '</id><timestamp>' || CASE WHEN o_orderkey % 101 = 7 THEN 'no time'
      ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END || '</timestamp>' || CASE WHEN o_orderkey % 103 = 5 THEN '<b>' ELSE '' END ||
      '<text bytes="' || CAST(floor(o_totalprice) AS BIGINT) || '" /></revision>' AS record
  FROM orders),
hist_pages AS (SELECT c_custkey AS page_id, c_custkey % 9 = 4 AS redirect,
    CAST(count(rev_id) FILTER (reject IS NULL) AS BIGINT) AS revi_count, CAST(count(reject) AS BIGINT) AS n_rejected
  FROM customer LEFT JOIN hist ON hist.page_id = c_custkey WHERE c_custkey % 211 <> 3 GROUP BY c_custkey)"""
ORACLE["src_history"] = with_(_HIST) + """
SELECT page_id, rev_pos, rev_id, epoch, bytes, NULL AS reject, NULL AS record FROM hist WHERE reject IS NULL
UNION ALL
SELECT CASE WHEN page_id % 211 <> 3 THEN page_id ELSE -1 END, -1, -1, -1, -1, reject, record FROM hist WHERE reject IS NOT NULL
UNION ALL
SELECT -1, -1, -1, -1, -1, 'no id', '<page><title>K' || c_custkey || '</title><ns>0</ns>' ||
  CASE WHEN c_custkey % 9 = 4 THEN '<redirect title="K' || c_custkey || '" />' ELSE '' END || chr(10) || '</page>'
FROM customer WHERE c_custkey % 211 = 3"""
ORACLE["revision_count"] = with_(_HIST) + "SELECT page_id, revi_count, n_rejected FROM hist_pages"
ORACLE["sink_history"] = with_(_HIST) + """SELECT CAST(p.page_id AS VARCHAR) || ',' ||
  coalesce(string_agg(CAST(epoch AS VARCHAR) || '-' || CAST(bytes AS VARCHAR), ',' ORDER BY rev_pos), '') AS value
FROM hist_pages p LEFT JOIN hist h ON h.page_id = p.page_id WHERE NOT redirect AND n_rejected = 0 GROUP BY p.page_id"""
ORACLE["rfc3339_epoch"] = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts_text,
  CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders"""
ORACLE["src_site_info"] = f"""WITH heads AS ({SITE_HEADER_SQL})
SELECT source, trim(header, {_WS}) AS site_info FROM heads"""
ORACLE["sink_page_store"] = with_(wiki_cte()) + "SELECT page_id, title, redirect_title, text FROM wiki_pages"
ORACLE["sink_page_index_table"] = _IX.rstrip() + f""",
{_HIST},
typed AS (SELECT page_id, title, {_PAGE_TYPE_SQL} AS page_type,
  CAST(coalesce(len(regexp_extract_all(text, {_q(LINK_PATTERN)})), 0) AS BIGINT) AS link_count,
  CAST(coalesce(len(regexp_extract_all(text, {_q(SECTION_PATTERN)})), 0) AS BIGINT) AS sect_count FROM wiki_pages)
SELECT c.page_id, c."offset" AS stream_st, t.link_count, t.sect_count, coalesce(h.revi_count, 0) AS revi_count, t.page_type,
  t.title AS page_title FROM idx c JOIN typed t ON t.page_id = c.page_id LEFT JOIN hist_pages h ON h.page_id = c.page_id"""
