"""Wiki-markup column functions, all built from native Spark expressions.

Everything here returns a ``Column`` (or transforms a DataFrame with extra
columns) so Catalyst keeps the work inside whole-stage code generation; there
is no Python UDF on this path.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns that must equal the reference's for the same results
# Blanked markup spans.  The comment pattern has no dot-all flag in the
# reference, so a comment spanning lines is not masked; Java's (?d) makes '.'
# stop only at '\n', as there.
MASK_PATTERNS = [
    ("<nowiki>", r"(?s)<nowiki>.*?</nowiki>"),
    ("<!--", r"(?d)<!--.*?-->"),
    ("<ref>", r"(?s)<ref>.*?</ref>"),
    ("<code>", r"(?s)<code>.*?</code>"),
    ("<noinclude>", r"(?s)<noinclude>.*?</noinclude>"),
    ("<includeonly>", r"(?s)<includeonly>.*?</includeonly>"),
]
CATEGORY_PATTERN = r"\[\[Category:([^|\]]*)"
LINK_PATTERN = r"\[\[([^\]]+)\]\]"
SECTION_PATTERN = r"==[^=]+=="
SPACE_RUN_PATTERN = "  +"
WS_CHARS = " \r\n\t"
# Title prefix -> page type; the first match wins, a redirect beats all of them.
PAGE_TYPE_PREFIXES = [
    ("Module:", "module"),
    ("Template:", "template"),
    ("Portal:", "portals"),
    ("Category:", "categories"),
    ("Help:", "help"),
    ("Wikipedia:", "wikipedia"),
]
# --- end of fixed values

_SPAN = "array<struct<s:int,e:int>>"
_SLICE = 128


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip only space, CR, LF and TAB from both ends (all-blank gives '')."""
    return F.btrim(_as_col(c), F.lit(WS_CHARS))


def collapse_spaces(c) -> Column:
    """Two or more spaces become one; tabs are left alone."""
    return F.regexp_replace(_as_col(c), SPACE_RUN_PATTERN, " ")


def count_links(c) -> Column:
    """Number of ``[[...]]`` links in raw text, 0 for a missing text."""
    return F.coalesce(F.regexp_count(_as_col(c), F.lit(LINK_PATTERN)), F.lit(0)).cast("bigint")


def count_sections(c) -> Column:
    """Number of ``==...==`` headings (non-overlapping, may cross lines)."""
    return F.coalesce(F.regexp_count(_as_col(c), F.lit(SECTION_PATTERN)), F.lit(0)).cast("bigint")


def page_type(title, redirect) -> Column:
    """Page type from the redirect flag and the case-sensitive title prefix."""
    title, redirect = _as_col(title), _as_col(redirect)
    expr = F.when(redirect.isNotNull(), F.lit("redirect"))
    for prefix, name in PAGE_TYPE_PREFIXES:
        expr = expr.when(title.startswith(prefix), F.lit(name))
    return expr.otherwise(F.lit("article"))


def _pattern_spans(text: Column, literal: str, pattern: str) -> Column:
    """Byte spans [s, e) of the non-overlapping matches of one pattern.

    ``split`` yields the gaps and ``regexp_extract_all`` the matches of the
    same left-to-right scan, so match i starts after gaps 0..i and matches
    0..i-1.  The literal test skips both regex scans for pages without the tag.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    lens = F.zip_with(gaps, found, lambda g, m: F.struct(
        F.octet_length(g).alias("g"), F.octet_length(m).alias("m")))
    lens = F.filter(lens, lambda x: x["m"].isNotNull())
    empty = F.array().cast(_SPAN)

    def step(acc, x):
        s = acc["pos"] + x["g"]
        e = s + x["m"]
        return F.struct(e.alias("pos"),
                        F.concat(acc["sp"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("sp"))

    # spans within each slice, then the slices one behind the other
    parts = let(lens, lambda a: F.transform(_slices(a), lambda part: F.aggregate(
        part, F.struct(F.lit(0).alias("pos"), empty.alias("sp")), step)))

    def behind(acc, part):
        moved = F.transform(part["sp"], lambda x: F.struct((acc["pos"] + x["s"]).alias("s"), (acc["pos"] + x["e"]).alias("e")))
        return F.struct((acc["pos"] + part["pos"]).alias("pos"), F.concat(acc["sp"], F.array(moved)).alias("sp"))

    nested = F.array().cast(f"array<{_SPAN}>")
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), nested.alias("sp")), behind, lambda acc: F.flatten(acc["sp"]))
    return F.when(F.instr(text, literal) > 0, spans).otherwise(empty)


def _slices(a: Column) -> Column:
    """``a`` in slices of ``_SLICE``.

    A fold copies the array it grows at every step.  Folding slices, and then
    the slices' results, keeps both arrays short, so the work stays in
    proportion to the spans of a page instead of their square.
    """
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / _SLICE).cast("int")),
                       lambda i: F.slice(a, (i * _SLICE + 1).cast("int"), _SLICE))


def _merge_spans(spans: Column) -> Column:
    """Union of sorted spans: overlapping or touching spans become one."""
    empty = F.array().cast(_SPAN)

    def step(acc, x):
        last = F.element_at(acc, -1)
        overlap = (F.size(acc) > 0) & (x["s"] <= last["e"])
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(overlap, merged).otherwise(F.concat(acc, F.array(x)))

    parts = let(F.array_sort(spans), lambda a: F.transform(_slices(a), lambda part: F.aggregate(part, empty, step)))

    def behind(acc, part):
        """``last`` is the span that may still grow; what lies before it is done."""
        last = F.element_at(acc["last"], 1)
        k = F.size(F.filter(part, lambda x: x["s"] <= last["e"]))
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], F.get(part, k - 1)["e"]).alias("e"))
        held = F.when(F.size(acc["last"]) == 0, part).when(k == 0, F.concat(acc["last"], part)).otherwise(
            F.concat(F.array(grown), F.slice(part, k + 1, F.greatest(F.size(part) - k, F.lit(0)))))
        # bound once: the next state reads it twice
        return let(held, lambda h: F.struct(
            F.concat(acc["done"], F.array(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))))).alias("done"),
            F.when(F.size(h) > 0, F.slice(h, -1, 1)).otherwise(empty).alias("last")))

    start = F.struct(F.array().cast(f"array<{_SPAN}>").alias("done"), empty.alias("last"))
    return F.aggregate(parts, start, behind, lambda acc: F.concat(F.flatten(acc["done"]), acc["last"]))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``).

    Column expressions referenced several times would otherwise be inlined
    into every reference by the optimizer and recomputed.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def masked_text(text) -> Column:
    """The text with the union of all markup spans blanked byte for byte (see ``mask_markup``).

    The expression is large and fixed; for a named column it is built once per
    process (an unresolved Column can be reused by any DataFrame).
    """
    if isinstance(text, str):
        from pyspark import SparkContext
        return _masked_text_named(text, id(SparkContext._gateway))
    return _build_masked_text(text)


@functools.lru_cache(maxsize=32)
def _masked_text_named(name: str, gateway: int) -> Column:
    """Cached per column name and per JVM gateway (a relaunched JVM gets a fresh Column)."""
    return _build_masked_text(F.col(name))


def _build_masked_text(text) -> Column:
    t = _as_col(text)
    span_lists = [_pattern_spans(t, lit, pat) for lit, pat in MASK_PATTERNS]
    all_spans = F.concat(*span_lists)
    spans = F.when(F.instr(t, "<") > 0, _merge_spans(all_spans)).otherwise(F.array().cast(_SPAN))

    def rebuild(m, b):
        def piece(sp, i):
            prev = F.when(i == 0, F.lit(0)).otherwise(F.element_at(m, i)["e"])
            keep = F.decode(b.substr(prev + 1, sp["s"] - prev), "UTF-8")
            return F.concat(keep, F.repeat(F.lit(" "), sp["e"] - sp["s"]))

        last_end = F.coalesce(F.element_at(m, -1)["e"], F.lit(0))
        tail = F.decode(b.substr(last_end + 1, F.octet_length(b) - last_end), "UTF-8")
        return F.concat(F.array_join(F.transform(m, piece), ""), tail)

    return let(spans, lambda m: F.when(F.size(m) == 0, t).otherwise(
        let(F.encode(t, "UTF-8"), lambda b: rebuild(m, b))))


def mask_markup(df: DataFrame, text_col: str, out_col: str = "masked") -> DataFrame:
    """Blank (byte for byte, with spaces) the union of all markup spans.

    All spans are found on the original text, then merged, then blanked, so a
    comment that opens inside ``<nowiki>`` and a ``<nowiki>`` that opens inside
    a comment are both honoured.  Pages without ``<`` pass through untouched.
    """
    return df.withColumn(out_col, masked_text(text_col))


def extract_categories(c) -> Column:
    """Category names from masked text, in order, duplicates kept.

    Group 1 of ``[[Category:...`` up to ``|``, ``]`` or the end; trimmed of
    space/CR/LF/TAB; names still holding a newline are dropped; runs of
    spaces collapse to one.
    """
    found = F.regexp_extract_all(_as_col(c), F.lit(CATEGORY_PATTERN), 1)
    trimmed = F.transform(found, trim_ws)
    one_line = F.filter(trimmed, lambda x: F.instr(x, "\n") == 0)
    return F.transform(one_line, collapse_spaces)


# --- fixed values: code point ranges that are not allowed in XML text
XML_BAD_RANGES = [(0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F),
                  (0xFDD0, 0xFDDF), (0xFFFE, 0xFFFF)]
# plus the last two code points of every supplementary plane (rule, planes 1..16)
XML_BAD_RANGES += [(plane * 0x10000 + 0xFFFE, plane * 0x10000 + 0xFFFF) for plane in range(1, 17)]
# --- end of fixed values
XML_BAD_CLASS = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in XML_BAD_RANGES) + "]"


def numbered(arr, pos_name: str, value_name: str) -> Column:
    """Generator of ``(pos, value)`` rows (1-based) for a computed array.

    ``inline(transform(...))`` evaluates the array expression once per row;
    ``posexplode`` over a computed array measured ~3.5x slower here.
    """
    return F.inline(F.transform(_as_col(arr), lambda x, i: F.struct(
        (i + 1).cast("bigint").alias(pos_name), x.alias(value_name))))


def xml_scrub(c, replacement: str = "") -> Column:
    """Replace every character XML does not allow with ``replacement``."""
    return F.regexp_replace(_as_col(c), XML_BAD_CLASS, replacement)


def str_translate(c, src: str, dst: str) -> Column:
    """Character-for-character map; both strings must have the same length."""
    if len(src) != len(dst):
        raise ValueError("str_translate needs equal-length source and target")
    return F.translate(_as_col(c), src, dst)


def sha256_hex(c) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(_as_col(c), 256)
