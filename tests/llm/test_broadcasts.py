"""What joins send to every task, read from the plans: Spark sizes rows behind an explode as those before it."""

from pyspark.sql import functions as F

import corpus_pipeline
from pagelake.llm import common, components, disclosure, mixing, packing, simhash
from pagelake.llm.common import BROADCAST_ROWS, documents, written

SF = "/root/testdata/sf0.001"


def sent(df):
    """The plan below each broadcast of ``df``, a text each."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def exploded(df):
    return [x for x in sent(df) if "Generate " in x]


def test_plans_are_read_right(spark):
    few = spark.range(5).select(F.col("id").alias("a"), F.explode(F.array(F.lit(1), F.lit(2))).alias("b"))
    assert len(exploded(spark.range(9).join(F.broadcast(few), F.col("id") == F.col("a")))) == 1
    other = spark.range(9).join(F.broadcast(spark.range(3).toDF("k")), F.col("id") == F.col("k"))
    assert len(sent(other)) == 1 and exploded(few.join(other.hint("merge"), F.col("id") == F.col("a"))) == []


def test_fingerprints_per_mask_are_not_sent_to_every_task(spark):
    fps = written(spark.range(300).select(F.xxhash64("id").alias("fp")).union(spark.range(40).toDF("fp")), "test")
    for max_bits in (4, 3):
        for hot, finer in ((512, (12,)), (8, (12,)), (2, ())):
            plan = simhash.links(fps, max_bits, hot=hot, finer=finer)
            assert exploded(plan) == [], (max_bits, hot, finer)


def test_many_nodes_or_crowded_buckets_are_joined_by_key(spark, monkeypatch):
    edges = written(spark.range(50).select((F.col("id") + 100).alias("u"), (F.col("id") % 7).alias("v")), "test")
    for star in (components._large_star, components._small_star):
        assert sent(star(edges, BROADCAST_ROWS + 1)) == [] and len(sent(star(edges, 50))) == 1
    fps = written(spark.range(60).select(F.col("id").alias("fp")), "test")
    assert len(sent(simhash.links(fps, hot=2))) > 0
    monkeypatch.setattr("pagelake.llm.common.BROADCAST_ROWS", 0)
    assert sent(simhash.links(fps, hot=2)) == []


def test_no_stage_of_the_pipeline_sends_exploded_rows(spark, monkeypatch):
    found = []

    def seen(df, name):
        found.extend((name, x) for x in exploded(df))
        return common.written(df, name)

    for module in (components, disclosure, mixing, packing, simhash):
        monkeypatch.setattr(module, "written", seen)
    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        docs = seen(stage(spark, docs, SF), name)
    assert found == []


def test_places_of_terms_are_not_sent(spark, monkeypatch):
    docs = written(spark.createDataFrame([("some words here",)], "text string"), "test")
    terms = written(spark.createDataFrame([(f"word{i}", 1.0) for i in range(2000)], "term string, revealed double"), "test")
    for limit in (disclosure.SENT_TERMS, 0):
        monkeypatch.setattr(disclosure, "SENT_TERMS", limit)
        assert exploded(disclosure._elsewhere(docs, terms, "text")) == []


def test_many_pairs_and_copies_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr("pagelake.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr(disclosure, "BROADCAST_COPIED", 0)
    monkeypatch.setattr(disclosure, "SENT_TERMS", 0)
    docs = written(spark.createDataFrame([(i, f"Quillon{i % 7} {i % 50} at single{i % 9}@corp.example.org") for i in [*range(90)] * 2], "doc_id bigint, text string"), "test")
    found = written(disclosure.find(docs), "test")
    assert sent(disclosure._disclosing(docs, found, disclosure._held(found), "text", 0.1, 0.5)) == []
