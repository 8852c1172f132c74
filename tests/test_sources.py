import glob
import os
import random

from pyspark.sql import functions as F

from pagelake.functions import xml as X
from pagelake.operators.pages import page_json
from pagelake.sources import dump as D
from pagelake.sources import history as H
from pagelake.sources import sinks as S

HEADER = '<mediawiki xml:lang="en">\n  <siteinfo>\n    <sitename>Test</sitename>\n  </siteinfo>\n'
FOOTER = "</mediawiki>\n"


def _pages(spark):
    rows = [(1, "Alpha", None, "text with &amp; <b>tags</b> & [[Category:A]] and a literal </page> inside"),
            (2, "Help:Beta", "Alpha", "redirected"), (3, "Gamma: colon", None, None), (4, "Δelta", None, "  spaced  \n")]
    return spark.createDataFrame(rows, "page_id long, title string, redirect_title string, text string")


def _write_dump(spark, pages, path, compression=None):
    body = pages.select(X.render_page("page_id", "title", "redirect_title", "text").alias("r")).orderBy(F.lit(1))
    recs = [r.r for r in body.collect()]
    text = HEADER + "".join(recs) + FOOTER
    df = spark.createDataFrame([(text,)], "value string")
    S.write_lines(df, path, compression=compression)


def test_bz2_dump_round_trip(spark, scratch):
    pages = _pages(spark)
    path = os.path.join(scratch, "dump")
    _write_dump(spark, pages, path, compression="bzip2")
    assert any(f.endswith(".bz2") for f in os.listdir(path))
    got, bad = D.read_pages(spark, path)
    want = {tuple(r) for r in pages.collect()}
    assert {tuple(r) for r in got.collect()} == want
    assert bad.count() == 0
    info = D.read_site_info(spark, path).first()
    assert info.site_info.startswith("<mediawiki") and info.site_info.endswith("</siteinfo>")


def test_bad_records_go_to_rejects(spark, scratch):
    path = os.path.join(scratch, "bad")
    text = ("<page><title>ok</title><id>5</id><revision><text>t</text></revision></page>"
            "<page><title>broken<id>6</id></page>"
            "<page><title>no id</title></page>")
    S.write_lines(spark.createDataFrame([(text,)], "value string"), path)
    got, bad = D.read_pages(spark, path)
    assert [r.page_id for r in got.collect()] == [5]
    assert bad.count() == 2


def test_no_text_is_lost_to_a_malformed_record(spark):
    page = "<page><title>{t}</title><id>{i}</id><revision><id>{r}</id><text>{x}</text></revision></page>"
    recs = [page.format(t="a", i=1, r=1, x="fine &amp; well"), page.format(t="b", i=2, r=2, x="bare & here"),
            page.format(t="c", i=3, r="x7", x="wrong type"), page.format(t="d", i=4, r=4, x="stray <b> tag")]
    good, bad = D.split_parsed(spark.createDataFrame([(r,) for r in recs], "record string"))
    assert [(r.page_id, r.text) for r in good.collect()] == [(1, "fine & well")]
    assert sorted(r.record for r in bad.collect()) == sorted(recs[1:])


def _history(spark, texts, path):
    """One file per text, without any separator behind it."""
    os.makedirs(path)
    for i, text in enumerate(texts):
        with open(os.path.join(path, f"shard{i}.xml"), "w", encoding="utf-8") as fh:
            fh.write(text)
    return H.read_history(spark, path)


def test_history_keeps_pages_without_revisions(spark, scratch):
    text = ("<page><title>none</title><id>1</id></page><page><title>one</title><id>2</id><revision><id>3</id>"
            "<timestamp>2001-01-01T00:00:00Z</timestamp></revision></page><page><title>x & y</title><id>4</id></page>"
            "<page><title>last</title><id>5</id></page>" + FOOTER)
    h = _history(spark, [HEADER + text], os.path.join(scratch, "h"))
    assert sorted((r.page_id, r.revi_count) for r in h.pages.collect()) == [(1, 0), (2, 1), (5, 0)]
    assert [(r.record, r.reject) for r in h.rejects.collect()] == [("<page><title>x & y</title><id>4</id></page>", "malformed")]
    assert sorted(r.value for r in H.history_lines(h).collect()) == ["1,", "2,978307200-", "5,"]


def test_revisions_of_a_page_run_through_many_splits(spark, scratch):
    """Every page boundary falls somewhere else in its split, and the largest page spans most of them."""
    rnd, want, pages, texts = random.Random(3), [], [], []
    for f in range(2):
        text = HEADER + ("<revision><id>999</id><timestamp>2001-01-01T00:00:00Z</timestamp></revision>" if f else "")
        for p in range(30):
            page_id = f * 100 + p
            text += f"  <page>\n <title>P{page_id}</title><id>{page_id}</id>\n" + ('<redirect title="x" />' if p % 7 == 6 else "")
            n = 900 if p == 11 else rnd.choice([0, 0, 1, 2, 9])
            for r in range(n):
                bad = rnd.random() < 0.02
                time = "soon" if bad else f"2001-01-01T00:{r // 60:02d}:{r % 60:02d}Z"
                text += f"<revision><id>{r}</id><timestamp>{time}</timestamp><text bytes=\"{r}\" /></revision>\n"
                if not bad:
                    want.append((page_id, r + 1, r, r))
            pages.append((page_id, n))
            text += "</page>\n"
        texts.append(text + FOOTER)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 * 1024))
    try:
        h = _history(spark, texts, os.path.join(scratch, "many"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert h.revisions.select("page_key.file", "page_key.block").distinct().count() >= 4
    assert sorted((r.page_id, r.rev_pos, r.rev_id, r.bytes) for r in h.revisions.collect()) == sorted(want)
    assert sorted((r.page_id, r.revi_count + r.n_rejected) for r in h.pages.collect()) == sorted(pages)
    rejects = [r.reject for r in h.rejects.collect()]
    assert rejects.count("no page") == 1 and rejects.count("bad timestamp") == sum(n for _, n in pages) - len(want)
    by_page = {}
    for page_id, _, _, size in sorted(want):
        by_page.setdefault(page_id, []).append(f"{978307200 + size}-{size}")
    whole = [p for p, n in pages if p % 100 % 7 != 6 and len(by_page.get(p, [])) == n]
    assert sorted(r.value for r in H.history_lines(h).collect()) == sorted(f"{p}," + ",".join(by_page.get(p, [])) for p in whole)


def test_a_split_is_ordered_in_slices(spark, scratch, monkeypatch):
    """One split in many slices: the same rows, and no task orders or groups a whole split."""
    text = HEADER + "".join(
        f"<page><title>P{p}</title><id>{p}</id>" + "".join(
            f"<revision><id>{r}</id><timestamp>2001-01-01T00:00:00Z</timestamp></revision>" for r in range(n)) + "</page>"
        for p, n in enumerate([0, 3, 70, 0, 1, 200, 5])) + FOOTER
    monkeypatch.setattr(H, "SLICE", 16)
    made = []
    monkeypatch.setattr(H, "cut_lineage", lambda d: made.append(d.persist()) or made[-1])
    h = _history(spark, [text], os.path.join(scratch, "sliced"))
    assert sorted((r.page_id, r.revi_count) for r in h.pages.collect()) == list(enumerate([0, 3, 70, 0, 1, 200, 5]))
    assert sorted((r.page_id, r.rev_pos, r.rev_id) for r in h.revisions.collect()) == sorted(
        (p, r + 1, r) for p, n in enumerate([0, 3, 70, 0, 1, 200, 5]) for r in range(n))
    groups = made[0].groupBy("file", "block", "slice").agg(F.countDistinct("at").alias("n"), F.count_if("ends").alias("last")).collect()
    assert len(groups) == 18 and all(g["n"] <= 16 and g["last"] == 1 for g in groups)
    assert "SortAggregate" not in H._carried(made[0])._jdf.queryExecution().executedPlan().toString()


def test_rejects_and_accepted_rows_come_from_one_pass(spark, scratch):
    path = os.path.join(scratch, "bad")
    text = ("<page><title>ok</title><id>5</id><revision><text>t</text></revision></page>"
            "<page><title>broken<id>6</id></page><page><title>no id</title></page>")
    S.write_lines(spark.createDataFrame([(text,)], "value string"), path)
    c = D.check_pages(spark, path)
    assert (c.n_rows, c.n_rejects) == (3, 2) and [r.page_id for r in c.accepted.collect()] == [5]
    assert sorted((r.reject, r.record) for r in c.rejects.collect()) == [
        ("malformed", "<page><title>broken<id>6</id></page>"), ("no id", "<page><title>no id</title></page>")]
    plan = c.accepted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__rejected" in plan and "from_xml" not in plan
    nothing = D.split_rows(D.tagged_pages(spark.createDataFrame([], "record string")))
    assert (nothing.n_rows, nothing.accepted.count(), nothing.rejects.count()) == (0, 0, 0)


def test_page_skeleton_ignores_quotes_in_text(spark):
    rec = """<page><comment>x='b</comment><text bytes="3" note='a > b'>it's fine</text>\n <minor />\n</page>"""
    got = spark.createDataFrame([(rec,)], "r string").select(X.page_skeleton("r").alias("s")).first().s
    assert got == "<page><comment></comment><text bytes note></text><minor/></page>"


def test_history_shards_and_sink(spark, scratch):
    shard = ('<page><title>K1</title><ns>0</ns><id>1</id>'
             '<revision><id>10</id><timestamp>2001-01-01T00:00:00Z</timestamp><text bytes="7" /></revision>'
             '<revision><id>11</id><timestamp>2001-01-02T00:00:00Z</timestamp><text bytes="9" /></revision></page>'
             '<page><title>K2</title><ns>0</ns><id>2</id><redirect title="K1" />'
             '<revision><id>12</id><timestamp>2001-01-03T00:00:00Z</timestamp><text bytes="1" /></revision></page>'
             '<page><title>K3</title><ns>0</ns><id>3</id>'
             '<revision><id>13</id><timestamp>not a time</timestamp><text bytes="1" /></revision></page>')
    for i in range(2):
        S.write_lines(spark.createDataFrame([(shard,)], "value string"), os.path.join(scratch, f"h{i}"))
    hist = H.read_history(spark, os.path.join(scratch, "h*"))
    assert hist.revisions.count() == 6 and hist.pages.count() == 6
    assert [r.reject for r in hist.rejects.collect()] == ["bad timestamp"] * 2
    out = os.path.join(scratch, "hist_out")
    S.write_history(hist, out)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert lines == ["1,978307200-7,978393600-9"] * 2


def test_ordered_lines_take_tasks_by_their_rows(spark, scratch, monkeypatch):
    """A task sorts a share of the rows that does not grow with them; groups stay whole and in order."""
    monkeypatch.setattr(S, "ORDERED_ROWS", 64, raising=False)
    path = os.path.join(scratch, "lines")
    rows = spark.range(3000).select((F.col("id") % 300).alias("key"), (-F.col("id")).alias("at")).withColumn("value", F.concat_ws(":", "key", "at"))
    S.write_ordered_lines(rows, path, "key", ["at"])
    files = [[tuple(map(int, line.split(":"))) for line in open(f)] for f in glob.glob(os.path.join(path, "part-*"))]
    assert len(files) > 30 and max(map(len, files)) < 300
    assert all(f == sorted(f) for f in files) and sorted(x for f in files for x in f) == sorted((i % 300, -i) for i in range(3000))
    assert sum(len({key for key, _ in f}) for f in files) == 300


def test_page_store_point_lookup_is_pushed(spark, scratch):
    path = os.path.join(scratch, "store")
    S.write_page_store(_pages(spark), path)
    one = spark.read.parquet(path).where(F.col("page_id") == 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,3)]" in plan
    assert one.first().title == "Gamma: colon"


def test_media_files(spark, scratch):
    d = os.path.join(scratch, "media")
    os.makedirs(d)
    blobs = {"a.png": b"\x89PNG\r\n\x1a\nrest", "b.gif": b"GIF89a...", "c.pgm": b"P5\n1 1", "d.webp": b"RIFF\0\0\0\0WEBPx",
             "e.bin": b"\x00\x01", "f.jpg": b"\x00\x00\x00\x00\x00\x00JFIF"}
    for name, data in blobs.items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    got = {os.path.basename(r.path): r.media_type for r in D.read_media(spark, d).collect()}
    assert got == {"a.png": "png", "b.gif": "gif", "c.pgm": "pgm", "d.webp": "webp", "e.bin": None, "f.jpg": "jpeg"}


def test_xml_validate_cases(spark):
    recs = ["<page><title>a</title></page>", "<page><title>a & b</title></page>", "<page><title>a</titl></page>",
            "<page><title>a</title></page></page>", "<page><title>a</title></page>trailing", "junk", None]
    df = spark.createDataFrame([(r,) for r in recs], "r string")
    assert [r.ok for r in df.select(X.xml_valid("r").alias("ok")).collect()] == [True, False, False, False, False,
                                                                                  False, False]


def test_one_bz2_file_splits_and_every_page_is_read_once(spark, scratch):
    n = 3000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"),
                                  F.lit(None).cast("string").alias("redirect_title"),
                                  F.concat(F.lit("[[Category:C"), (F.col("id") % 7).cast("string"), F.lit("]] "),
                                           F.repeat(F.lit("lorem ipsum "), 40)).alias("text"))
    path = os.path.join(scratch, "one_file")
    recs = pages.select(X.render_page("page_id", "title", "redirect_title", "text").alias("record")).coalesce(1)
    S.write_dump(recs, path)
    assert len([f for f in os.listdir(path) if f.endswith(".bz2")]) == 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 * 1024))
    try:
        got, bad = D.read_pages(spark, path)
        assert got.rdd.getNumPartitions() > 1
        ids = [r.page_id for r in got.select("page_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(ids) == list(range(n))
    assert bad.count() == 0


def test_page_json_filter(spark):
    recs = _pages(spark).select(X.render_page("page_id", "title", "redirect_title", "text").alias("record"))
    got = page_json(recs, [2, 3]).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [2, 3]
    assert got[1].json == '{"page_id":3,"title":"Gamma: colon","redirect_title":null,"text":null}'


def test_record_store_is_pruned_by_id_before_parsing(spark, scratch):
    path = os.path.join(scratch, "records")
    recs = _pages(spark).select(X.render_page("page_id", "title", "redirect_title", "text").alias("record"))
    broken = spark.createDataFrame([("<page><title>no id</title><revision><id>3</id></revision></page>",)], "record string")
    S.write_record_store(recs.unionByName(broken), path)
    few = D.read_records(spark, path, [3, 4])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(page_id, [3,4])]" in plan and "from_xml" not in plan
    got = page_json(few).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [3, 4] and got[0].json == '{"page_id":3,"title":"Gamma: colon","redirect_title":null,"text":null}'
    ids = spark.createDataFrame([(2,), (4,), (None,), (2,)], "page_id long")
    by_table = D.read_records(spark, path, ids)
    assert "GreaterThanOrEqual(page_id,2), LessThanOrEqual(page_id,4)" in by_table._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.page_id for r in by_table.collect()) == [2, 4]
    assert D.read_records(spark, path, ids.limit(0)).count() == 0
    assert [r.page_id for r in page_json(spark.read.parquet(path), [1]).collect()] == [1]
