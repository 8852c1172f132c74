import random
import re

import duckdb
import pytest

from pagelake.llm import mixing as M
from pagelake.llm.sql import mixing_sql
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level_by_rounds(sizes, weights):
    """Targets by sharing again and again what the limits leave over."""
    total, limit, target, open_ = sum(sizes), [3 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        share = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / share > limit[i]}
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / share
            return target
        for i in over:
            target[i] = float(limit[i])
        open_ -= over


def test_targets_match_repeated_sharing(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = [rng.choice([1, 5, 40, 300, 2000]) for _ in range(rng.randint(1, 9))]
        rows = [(i, f"s{j}", n) for i, (j, n) in enumerate(enumerate(sizes))]
        df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
        got = [r["target"] for r in M.allocate(df).orderBy("source").collect()]
        assert got == pytest.approx(level_by_rounds(sizes, [(5, 2, 1)[j % 3] for j in range(len(sizes))]))


def corpus(spark, n=600):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 120))), rng.choice(["a"] * 9 + ["b", "c", "d", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


def test_each_source_comes_near_its_target(spark):
    rows, df = corpus(spark)
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", "c", "d", None):
        own = [r for r in got if r["source"] == source]
        target = own[0]["target"]
        assert abs(sum(r["taken"] for r in own) - target) <= max(2, 0.01 * target)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in own)
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own if r["size"]) <= 1
    assert sorted(map(tuple, M.mix(df.repartition(7)).select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_long_documents_are_drawn_more_often(spark):
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 40)), "a" if i < 1000 else "b") for i in range(1300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [r for r in M.mix(df, weights=(1.0, 1.0)).collect() if r["source"] == "a"]
    base = min(r["copies"] for r in got)
    long = sum(r["copies"] - base for r in got if r["size"] == 40)
    short = sum(r["copies"] - base for r in got if r["size"] == 10)
    assert long > 2.5 * short > 0


def skewed():
    """Sources with one document longer than the words wanted of them."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["a", "a", "b", "c", None])) for i in range(500)]
    rows += [(900, "w " * 9000, "a"), (901, "w " * 3000, "c"), (902, "w " * 700, None), (903, "w " * 700, None)]
    return rows + rows[:40]


def test_matches_sql_on_odd_and_random_documents(spark):
    for data in (corpus(spark)[0], [(r[0], r[1], r[3]) for r in odd.rows()], skewed(), []):
        df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        for row in data:
            con.execute("INSERT INTO documents VALUES (?, ?, ?)", list(row))
        key = lambda r: tuple((x is None, x or 0) for x in r)
        want = sorted(con.execute(mixing_sql()).fetchall(), key=key)
        got = sorted(map(tuple, M.mix(df, fill=True).select("doc_id", "size", "source_size", "target", "taken").collect()), key=key)
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_repeat_emits_whole_copies(spark):
    df = odd.docs(spark)
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in M.mix(df).collect()}
    out = M.repeat(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in M.mix(df).collect())
    assert copies[(8, 0)] >= 0 and M.repeat(odd.empty(spark)).count() == 0 and M.mix(odd.empty(spark)).count() == 0


def test_many_sources_are_joined_instead_of_sent(spark, monkeypatch):
    rows, df = corpus(spark)
    want = sorted(map(tuple, M.mix(df).select("doc_id", "taken").collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, M.mix(df).select("doc_id", "taken").collect())) == want


def test_rounds_take_a_source_with_one_long_document_to_its_target(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "a") for i in range(600)] + [(5000, " ".join(["w"] * 18_000), "a")]
    rows += [(6000 + i, " ".join(["w"] * rng.randint(1, 30)), None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(2)
    for seed in ("x-1", "x-2"):
        got = [r for r in M.mix(df, weights=(1.0, 4.0), seed=seed, fill=True).collect() if r["source"] == "a"]
        target = got[0]["target"]
        assert target < 9000 and abs(sum(r["taken"] for r in got) - target) <= 2


def test_rounds_keep_whole_copies_and_ties(spark):
    for df in (odd.docs(spark), corpus(spark, 200)[1].union(corpus(spark, 200)[1])):
        got = M.mix(df, fill=True).collect()
        for source in {r["source"] for r in got}:
            own = [r for r in got if r["source"] == source]
            copies = {}
            for r in own:
                assert copies.setdefault((r["doc_id"], r["size"]), r["copies"]) == r["copies"] <= 3
            # what is missing is shorter than any document left out, or its neighbour comes no nearer
            gap = own[0]["target"] - sum(r["taken"] for r in own)
            base = min((r["copies"] for r in own if r["size"]), default=0)
            left = [r["size"] * sum((x["doc_id"], x["size"]) == (r["doc_id"], r["size"]) for x in own)
                    for r in own if r["size"] and r["copies"] == base and base < 3]
            assert gap < 1e-6 or all(n > gap and n - gap >= gap for n in left) or own[0]["target"] >= 3 * own[0]["source_size"]
        again = M.mix(df.repartition(7), fill=True).select("doc_id", "size", "taken").collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(map(tuple, again), key=key) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=key)
    assert M.mix(odd.empty(spark), fill=True).count() == 0
