import random

import pytest

from pagelake.operators.windows import as_of, last_seen, next_value, one_block, running_total


def test_running_total_across_blocks_with_ties(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 5000), i, rnd.randint(-5, 20)) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, tie long, v long")
    for inclusive in (False, True):
        got = {r.tie: r.run for r in running_total(df, ["k", "tie"], "v", "run", 97, inclusive).collect()}
        acc = 0
        for k, tie, v in sorted(rows):
            if inclusive:
                acc += v
                assert got[tie] == acc
            else:
                assert got[tie] == acc
                acc += v


def test_next_value_skips_empty_blocks(spark):
    rnd = random.Random(9)
    keys = sorted(rnd.sample(range(0, 10 ** 7), 400))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.nx for r in next_value(df, "k", "nx", 10 ** 7 + 1, 4096).collect()}
    for a, b in zip(keys, keys[1:] + [10 ** 7 + 1]):
        assert got[a] == b


def test_running_total_per_key_with_hot_key(spark):
    rnd = random.Random(2)
    rows = [(0, rnd.randint(0, 10 ** 6), 1) for _ in range(900)]                  # hot key over many blocks
    rows += [(k, rnd.randint(0, 10 ** 6), rnd.randint(1, 9)) for k in range(1, 30) for _ in range(rnd.randint(0, 20))]
    rows = [(k, o, v, i) for i, (k, o, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k long, o long, v long, i long")
    got = {r.i: r.run for r in running_total(df, ["o", "i"], "v", "run", 1000, True, partition_cols=["k"]).collect()}
    acc = {}
    for k, o, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        acc[k] = acc.get(k, 0) + v
        assert got[i] == acc[k]


@pytest.mark.parametrize("width", [50, 10 ** 9])
@pytest.mark.parametrize("inclusive", [True, False])
def test_last_value_over_blocks_computes_its_input_once(spark, width, inclusive):
    """A hot key over many blocks, keys of one block, rows without a value; and with a value in no earlier block."""
    rnd = random.Random(4)
    rows = [(0 if i % 2 else rnd.randint(1, 40), rnd.randint(0, 999) * 1000 + i, rnd.choice([None, None, "a", "b"])) for i in range(900)]
    seen = spark.sparkContext.accumulator(0)
    rdd = spark.sparkContext.parallelize(rows, 3).map(lambda r: (seen.add(1), r)[1])
    df = spark.createDataFrame(rdd, "k long, o long, v string")
    got = {r.o: r.x for r in last_seen(df, ["k"], ["o"], {"x": "v"}, width * 1000, inclusive).collect()}
    assert seen.value == len(rows) and len(got) == len(rows)
    last = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        before = last.get(k)
        last[k] = v or before
        assert got[o] == (last[k] if inclusive else before)


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_events_of_one_time_are_ordered_by_their_tie(spark, width):
    rnd = random.Random(6)
    events = [(rnd.randint(0, 4), rnd.randint(0, 20), i, rnd.choice([None, i])) for i in range(200)]
    asked = [(i, rnd.choice([None, 0, 1, 2, 3, 4, 5]), rnd.randint(0, 22)) for i in range(150)]
    e = spark.createDataFrame(events, "key long, seq long, tie long, val long")
    r = spark.createDataFrame(asked, "id long, key long, seq long")
    got = {x.id: x.val for x in as_of(r, "key", ["seq"], {"val": e}, width).collect()}
    assert len(got) == len(asked)
    for i, key, seq in asked:
        mine = [(s, t, v) for k, s, t, v in events if k == key and s <= seq]
        assert got[i] == (max(mine, key=lambda m: m[:2])[2] if mine else None)


def test_times_of_one_block_pass_in_one_shuffle_and_are_not_written(spark):
    """Requests without other columns, without a key, and events that set one of two values or a null."""
    rnd = random.Random(8)
    events = [(rnd.randint(0, 4), rnd.randint(0, 20), i, rnd.choice([None, i]), rnd.random() < 0.5, rnd.random() < 0.5) for i in range(200)]
    asked = list({(rnd.choice([None, 0, 1, 2, 3, 4, 5]), rnd.randint(0, 22)) for _ in range(150)})
    e = spark.createDataFrame(events, "key long, seq long, tie long, val long, has_a boolean, has_b boolean")
    told = e.selectExpr("key", "seq", "tie", "if(has_a, struct(val as v), null) a", "if(has_b, struct(-val as v), null) b")
    r = spark.createDataFrame(asked, "key long, seq long")
    assert one_block([r, e], "seq", 1 << 16) and not one_block([r, e], "seq", 5)
    plans = {}
    for width, single in ((1 << 16, True), (1 << 16, False), (5, False)):
        found = as_of(r, "key", ["seq"], {("a", "b"): told}, width, single=single)
        plans[width, single] = found._jdf.queryExecution().executedPlan().toString()
        got = {(x.key, x.seq): (x.a, x.b) for x in found.collect()}
        assert len(got) == len(asked)
        for key, seq in asked:
            mine = sorted(((s, t, v, a, b) for k, s, t, v, a, b in events if k == key and s <= seq), key=lambda m: m[:2])
            last_a, last_b = [v for _, _, v, a, _ in mine if a], [v for _, _, v, _, b in mine if b]
            assert got[key, seq] == (last_a[-1] if last_a else None, -last_b[-1] if last_b and last_b[-1] is not None else None)
    assert plans[1 << 16, True].count("Exchange hashpartitioning") == 1 and "parquet" not in plans[1 << 16, True].lower()
    assert "parquet" in plans[1 << 16, False].lower()
