import os

from pyspark.sql import functions as F

from pagelake.functions import xml as X
from pagelake.operators import pages as P
from pagelake.sources import sinks as S
from pagelake.streaming.category_stream import stream_category_index


def test_stream_matches_batch(spark, scratch):
    pages = spark.createDataFrame(
        [(1, "Alpha", None, "[[Category:A]] <!-- [[Category:Hidden]] --> [[Category: B  |x]]"),
         (2, "Template:T", None, "[[Category:T]]"), (3, "Red", "Alpha", "[[Category:R]]"),
         (4, "Category:A", None, "<nowiki>[[Category:N]]</nowiki>[[Category:Root]]")],
        "page_id long, title string, redirect_title string, text string")
    src = os.path.join(scratch, "incoming")
    recs = [r.r for r in pages.select(X.render_page("page_id", "title", "redirect_title", "text").alias("r")).collect()]
    S.write_lines(spark.createDataFrame([("".join(recs[:2]),)], "value string"), os.path.join(src, "part1"))
    S.write_lines(spark.createDataFrame([("".join(recs[2:]),)], "value string"), os.path.join(src, "part2"))
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    q = stream_category_index(spark, os.path.join(src, "*"), out, ckpt)
    q.awaitTermination(120)
    got = sorted((r.page_id, r.cats) for r in spark.read.parquet(out).collect())
    batch = P.page_categories(pages).select("page_id", F.array_join("cats", "|").alias("cats"))
    assert got == sorted(tuple(r) for r in batch.collect()) == [(1, "A|B"), (4, "Root")]
