import random
import time

from pyspark.sql import functions as F

from pagelake.functions import text as T
from pyref import categories, mask

EDGE_TEXTS = [
    None,
    "",
    "no markup at all [[Category:Plain]]",
    "<nowiki>a <!-- b</nowiki> c --> [[Category:Hidden]] d",          # crossing spans
    "<!-- <nowiki> --> [[Category:KZ]] </nowiki> [[Category:Seen]]",   # comment opens inside nowiki
    "<ref>x<ref>y</ref> [[Category:AfterRef]] </ref>",                 # nested tags
    "<code>unclosed [[Category:Kept]]",                                # unclosed tag
    "<!-- multi\nline [[Category:Multi]] -->",                          # comment over lines is not masked
    "[[Category:  Spaced   Out  |key]]\r\n[[Category:\tTabbed\t]]",   # trim + collapse, tabs kept inside
    "[[Category:Broken\nName]] [[Category:Ok]]",                        # newline rule
    "[[Category:Unclosed",                                              # runs to the end
    "😀<noinclude>😀[[Category:Emoji]]</noinclude>😀 [[Category:Ünï]]",   # non-BMP + multibyte
    "<includeonly>\n[[Category:Inc]]\n</includeonly>[[Category:Dup]][[Category:Dup]]",
    "<ref name=x>[[Category:Attr]]</ref>",                              # attributed tag does not match
]

PIECES = ["<nowiki>", "</nowiki>", "<!--", "-->", "<ref>", "</ref>", "<code>", "</code>", "<noinclude>",
          "</noinclude>", "<includeonly>", "</includeonly>", "[[Category:", "]]", "|", "\n", "\r", "\t", "  ",
          "a", "Zé", "😀", " x ", "<", ">"]


def _random_texts(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def _run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = T.mask_markup(df, "text").withColumn("cats", T.extract_categories("masked"))
    return {r.id: (r.masked, r.cats) for r in out.collect()}


def test_mask_and_categories_edge_cases(spark):
    got = _run(spark, EDGE_TEXTS)
    for i, t in enumerate(EDGE_TEXTS):
        m, cats = got[i]
        assert m == mask(t), (t, m)
        if t is not None:
            assert list(cats) == categories(mask(t)), t


def test_mask_matches_loop_on_random_inputs(spark):
    texts = _random_texts(600)
    got = _run(spark, texts)
    bad = [t for i, t in enumerate(texts) if got[i][0] != mask(t) or list(got[i][1]) != categories(mask(t))]
    assert not bad, bad[:3]


def test_union_not_sequence(spark):
    # chained replacement (comment first) would leave KZ visible; the union hides it
    t = "<!-- <nowiki> --> [[Category:KZ]] </nowiki>"
    assert _run(spark, [t])[0][1] == []


def test_trim_collapse_counts(spark):
    df = spark.createDataFrame([(" \t a  b \r\n", "[[x]] [[y]] ==S== ===T=== [[z")], "s string, t string")
    r = df.select(T.trim_ws("s").alias("tr"), T.collapse_spaces("s").alias("co"),
                  T.count_links("t").alias("l"), T.count_sections("t").alias("n")).first()
    assert r.tr == "a  b"
    assert r.co == " \t a b \r\n"
    assert r.l == 2 and r.n == 2


def test_page_type_first_match(spark):
    rows = [("Module:X", None), ("Template:X", None), ("Portal:X", None), ("Category:X", None), ("Help:X", None),
            ("Wikipedia:X", None), ("X", None), ("Category:X", "Y"), ("category:x", None)]
    df = spark.createDataFrame(rows, "title string, redirect string")
    got = [r.t for r in df.select(T.page_type("title", "redirect").alias("t")).collect()]
    assert got == ["module", "template", "portals", "categories", "help", "wikipedia", "article", "redirect",
                   "article"]


def test_xml_scrub_and_translate_and_sha(spark):
    import hashlib
    df = spark.createDataFrame([("a\x00b\x0bc\x85d￾e\U0001fffef\ttab", "C#123")], "s string, n string")
    r = df.select(T.xml_scrub("s", "?").alias("x"), T.str_translate("n", "0123456789#", "abcdefghij-").alias("t"),
                  T.sha256_hex("n").alias("h")).first()
    assert r.x == "a?b?c\x85d?e?f\ttab"
    assert r.t == "C-bcd"
    assert r.h == hashlib.sha256(b"C#123").hexdigest()


def test_many_spans_fall_into_slices(spark):
    """Runs of spans longer than a slice, touching, overlapping and swallowing each other across slices."""
    rnd = random.Random(17)
    texts = ["<ref>é</ref>" * 700, "x<code>1</code> " * 300 + "<nowiki>" + "<ref>a</ref>b" * 400 + "</nowiki>" + "<ref></ref>" * 300]
    texts += ["".join(rnd.choice(PIECES) for _ in range(4000)) for _ in range(6)]
    texts += ["<!--" + "<ref>q</ref>" * n + "-->tail<code></code>" for n in (126, 127, 128, 129, 256)]
    got = _run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == mask(t)


def test_masking_time_stays_in_proportion_to_the_spans(spark):
    seconds = {}
    for n in (2_000, 20_000):
        df = spark.createDataFrame([("word <ref>abc</ref> " * n,)] * 2, "text string").coalesce(1)
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            T.mask_markup(df, "text").selectExpr("sum(length(masked)) AS n").collect()
            seconds[n] = time.perf_counter() - start
    assert seconds[20_000] < 25 * seconds[2_000] + 1, seconds
