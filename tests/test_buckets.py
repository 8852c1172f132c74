import os
import random

from pagelake.operators import ledger as L
from pagelake.sources import buckets as B

SCHEMA = "account_id bigint, item_id bigint, item_count bigint"


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, scratch):
    rnd, path = random.Random(2), os.path.join(scratch, "state")
    want = {(a, i): rnd.randint(1, 9) for a in range(200) for i in rnd.sample(range(20), 3)}
    state = spark.createDataFrame([(a, i, n) for (a, i), n in want.items()], SCHEMA)
    B.write_buckets(state, path, ["account_id"], 16)
    for batch in range(3):
        before = _files(path)
        bought = [(rnd.choice([3, 5, 900 + batch]), rnd.randrange(20), rnd.randint(1, 4), rnd.choice([L.OK, L.OK, L.INSUFFICIENT])) for _ in range(12)]
        rows = spark.createDataFrame(bought, SCHEMA + ", status string")
        touched = L.upsert_stored(spark, path, rows, state.schema, 16)
        for a, i, n, status in bought:
            if status == L.OK:
                want[a, i] = want.get((a, i), 0) + n
        got = {(r.account_id, r.item_id): r.item_count for r in B.read_buckets(spark, path, state.schema).collect()}
        assert got == want and 0 < len(touched) <= 3
        after = _files(path)
        kept = [f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched]
        assert kept and all(after.get(f) == before[f] for f in kept)


def test_inserts_ignore_what_is_there_and_nothing_to_do_writes_nothing(spark, scratch):
    path = os.path.join(scratch, "held")
    held = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "account_id bigint, page_id bigint")
    B.write_buckets(held, path, ["account_id"], 4)
    new = spark.createDataFrame([(1, 10), (1, 12), (1, 12), (7, 1), (None, 3)], "account_id bigint, page_id bigint")
    L.insert_stored(spark, path, new, ["account_id", "page_id"], held.schema, 4)
    got = sorted((tuple(r) for r in B.read_buckets(spark, path, held.schema).collect()), key=repr)
    assert got == sorted([(1, 10), (1, 11), (2, 10), (1, 12), (7, 1), (None, 3)], key=repr)
    before = _files(path)
    assert L.insert_stored(spark, path, new.limit(0), ["account_id", "page_id"], held.schema, 4) == [] and _files(path) == before
