import random

from pyspark.sql import functions as F

from pagelake.operators import index as IX
from pyref import greedy_packs


def test_parse_dump_index_rejects_bad_rows(spark):
    lines = spark.createDataFrame([("550:1:Title: with colon",), ("x:2:Bad offset",), ("600:3",), ("600:4:Ok",),
                                   ("junk",), ("",)], "value string")
    good, bad = IX.parse_dump_index(lines)
    assert sorted(tuple(r) for r in good.collect()) == [(550, 1, "Title: with colon"), (600, 4, "Ok")]
    assert sorted(r.line for r in bad.collect()) == ["", "600:3", "junk", "x:2:Bad offset"]
    counts = IX.index_line_counts(lines).first()
    assert (counts.n_lines, counts.n_rejects) == (6, 4)


def test_stream_ranges_last_ends_at_file_length(spark):
    idx = spark.createDataFrame([(550, 1, "a"), (550, 2, "b"), (900, 3, "c"), (5000, 4, "d")],
                                "offset long, page_id long, title string")
    rng = sorted(tuple(r) for r in IX.stream_ranges(idx, 7000).collect())
    assert rng == [(550, 900), (900, 5000), (5000, 7000)]


def test_greedy_packing_matches_loop(spark):
    rnd = random.Random(11)
    for limit in (1000, 5000):
        pos, ranges = 550, []
        for _ in range(120):
            size = rnd.choice([10, 200, 900, 3000, 12000])   # some streams larger than the limit
            ranges.append((pos, pos + size))
            pos += size
        df = spark.createDataFrame(ranges, "st long, ed long")
        got = {r.st for r in IX.greedy_pack_starts(df, limit).collect() if r.pack_start}
        want = {s for s in greedy_packs(ranges, limit) if s < pos}
        assert got == want, limit


def test_validate_index_flags_each_fault(spark):
    good = "<page><title>{t}</title><id>{i}</id><revision><id>9</id></revision></page>"
    rows = [(0, 1, "A"), (0, 2, " B "), (10, 3, "C"), (20, 4, "D"), (30, 5, "E"), (40, 6, "F & G")]
    recs = [good.format(t="A", i=1), good.format(t="B", i=2), good.format(t="Z", i=3), good.format(t="E", i=5)[:-9],
            good.format(t="F &amp; G", i=6), good.format(t="extra", i=7)]
    rep = IX.validate_index(spark.createDataFrame(rows, "offset long, page_id long, title string"),
                            spark.createDataFrame([(r,) for r in recs], "record string"))
    got = {r.offset: (r.n_indexed, r.n_stored, r.ids_ok, r.titles_ok, r.xml_ok, r.valid) for r in rep.collect()}
    assert got == {0: (2, 2, True, True, True, True), 10: (1, 1, True, False, True, False),   # wrong title
                   20: (1, 0, False, False, False, False),                                     # missing record
                   30: (1, 1, False, False, False, False),                                     # malformed record
                   40: (1, 1, True, True, True, True), -1: (0, 1, False, False, True, False)}  # not indexed
    assert IX.all_valid(rep).first().all_valid is False


def test_pages_by_stream_keeps_titles(spark):
    idx = spark.createDataFrame([(5, 12, "b"), (5, 3, "a: c"), (9, 1, "z")], "offset long, page_id long, title string")
    assert sorted(map(tuple, IX.pages_by_stream(idx).collect())) == [(5, 2, "3 a: c\n12 b"), (9, 1, "1 z")]
