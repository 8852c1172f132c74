"""XML record functions: render a page record, parse it, validate it, skeleton it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.schemas import PAGE_SCHEMA_DDL, STRING_PAGE_SCHEMA_DDL


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def xml_escape(c) -> Column:
    """Entity-encode ``&``, ``<``, ``>`` and ``"`` (attribute-safe)."""
    c = _as_col(c)
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def render_page(page_id, title, redirect_title, text, ts=None, rev_id=None) -> Column:
    """One ``<page>`` record in the dump layout (current-revision dump)."""
    page_id, title, redirect_title, text = map(_as_col, (page_id, title, redirect_title, text))
    ts = F.lit("2024-06-01T00:00:00Z") if ts is None else _as_col(ts)
    rev_id = page_id if rev_id is None else _as_col(rev_id)
    redirect = F.when(redirect_title.isNotNull(),
                      F.concat(F.lit('    <redirect title="'), xml_escape(redirect_title), F.lit('" />\n')))
    text_el = F.when(text.isNull(), F.lit('      <text bytes="0" />\n')).otherwise(F.concat(
        F.lit('      <text bytes="'), F.octet_length(text).cast("string"), F.lit('" xml:space="preserve">'),
        xml_escape(text), F.lit("</text>\n")))
    return F.concat(
        F.lit("  <page>\n    <title>"), xml_escape(title), F.lit("</title>\n    <ns>0</ns>\n    <id>"),
        page_id.cast("string"), F.lit("</id>\n"), F.coalesce(redirect, F.lit("")),
        F.lit("    <revision>\n      <id>"), rev_id.cast("string"), F.lit("</id>\n      <timestamp>"), ts,
        F.lit("</timestamp>\n"), text_el, F.lit("    </revision>\n  </page>\n"))


CORRUPT = "_corrupt_record"
XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def parse_page(record, schema_ddl: str = PAGE_SCHEMA_DDL) -> Column:
    """Parse one ``<page>...</page>`` record into the nested page struct; ``CORRUPT`` holds a record that does not parse."""
    return F.from_xml(_as_col(record), f"{schema_ddl}, {CORRUPT} STRING", XML_OPTIONS)


def flat_page(parsed) -> list[Column]:
    """``page_id, title, redirect_title, text`` from a parsed page struct."""
    p = _as_col(parsed)
    rev = F.try_element_at(p["revision"], F.lit(1))
    return [p["id"].alias("page_id"), p["title"].alias("title"),
            p["redirect"]["_title"].alias("redirect_title"), rev["text"]["_VALUE"].alias("text")]


def xml_valid(record) -> Column:
    """Well-formed record: parses without a corrupt record and ends in its one ``</page>``."""
    rec = _as_col(record)
    parsed = parse_page(rec, STRING_PAGE_SCHEMA_DDL)
    trimmed = F.rtrim(rec, F.lit(" \r\n\t"))
    one_end = (F.size(F.split(rec, "</page>", -1)) == 2) & trimmed.endswith("</page>")
    return rec.isNotNull() & parsed[CORRUPT].isNull() & one_end


# A tag, with quoted values that may hold any character; quotes in text do not count.
_TAG = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""


def page_skeleton(record) -> Column:
    """Tag names and attribute names of a record, without comments, text or values."""
    tags = F.regexp_extract_all(F.regexp_replace(_as_col(record), r"(?s)<!--.*?-->", ""), F.lit(_TAG), 0)
    bare = F.transform(tags, lambda t: F.regexp_replace(
        F.regexp_replace(t, r"""=\s*(?:"[^"]*"|'[^']*')""", ""), r"[ \t\r\n]+(/?>)", "$1"))
    return F.array_join(bare, "")
