"""Jump hashing against a loop in plain Python, slots, growth, and files."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import sharding
from pagelake.llm.queries import op11_shard_documents
from pagelake.llm.sql import ORACLE
from tests.llm import odd

MASK = (1 << 64) - 1


def brute_jump(key, shards):
    place, target = -1, 0
    while target < shards:
        place = target
        key = (key * 2862933555777941757 + 1) & MASK
        target = int((place + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return place


def key_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


def brute_place(rows, shards):
    """``rows`` are (doc_id, text); slots by the digest of (id, size, crc)."""
    out, by_shard = [], {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        name = f"{'' if doc_id is None else doc_id}:{size}:{crc}"
        shard = brute_jump(key_of(doc_id), shards)
        by_shard.setdefault(shard, []).append((hashlib.md5(name.encode()).hexdigest(), str(doc_id), doc_id, size, crc))
    for shard, held in by_shard.items():
        out += [(d, n, c, shard, i, brute_jump(key_of(d), shards + 1)) for i, (_, _, d, n, c) in enumerate(sorted(held, key=lambda x: x[:2]))]
    return sorted(out, key=repr)


def test_jump_matches_the_loop_and_moves_rows_into_new_shards_only():
    rng = random.Random(1)
    keys = np.array([rng.getrandbits(64) for _ in range(3000)] + [0, 1, MASK], "uint64")
    before = None
    for shards in (1, 2, 3, 8, 9, 100, 101, 5000):
        got = sharding.jump(keys, shards)
        assert got.tolist() == [brute_jump(int(k), shards) for k in keys]
        if before is not None:
            moved = got != before[0]
            assert (got[moved] >= before[1]).all()
        before = (got, shards)
    moved = (sharding.jump(keys, 9) != sharding.jump(keys, 8)).mean()
    assert abs(moved - 1 / 9) < 0.02
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


@pytest.mark.parametrize("block_rows, copies", [(50_000, 4096), (1, 2)])
def test_places_match_plain_python_on_odd_rows(spark, block_rows, copies):
    rows = odd.rows() + [odd.rows()[0]] * 9
    docs = spark.createDataFrame(rows, odd.SCHEMA).repartition(3)
    got = sharding.place(docs, 3, block_rows=block_rows, copies=copies)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_place([(r[0], r[1]) for r in rows], 3)


def test_empty_table(spark):
    assert sharding.place(odd.empty(spark)).collect() == []


def test_query_meets_its_contract_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in op11_shard_documents(spark, sf).collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r[3] for r in rows} == {"key"}
    for shard in {r[4] for r in rows}:
        assert sorted(r[5] for r in rows if r[4] == shard) == list(range(sum(r[4] == shard for r in rows)))
    for doc_id, size, crc, _, shard, _, grown in rows:
        raw = (texts[doc_id] or "").encode()
        assert (size, crc) == (len(raw) + 1, zlib.crc32(raw)) and grown in (shard, 8)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(ORACLE["op11_shard_documents"]).fetchall()
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_files_grow_by_the_rows_that_move(spark, scratch):
    path = f"{scratch}/shards"
    docs = odd.storable(spark.createDataFrame([(i, f"t{i % 7}", "en", "a", 2, *odd.EXTRA) for i in range(400)], odd.SCHEMA))
    sharding.write(docs, path, 4)
    assert sharding.read(spark, path, 4).count() == 400
    sharding.grow(spark, path, 4, 6)
    grown = {r["doc_id"]: r["shard"] for r in sharding.read(spark, path, 6).collect()}
    assert grown == {i: brute_jump(key_of(i), 6) for i in range(400)}
    held = spark.read.parquet(path)
    moved = sum(s >= 4 for s in grown.values())
    assert held.count() == 400 + moved and held.where(F.col("shard") >= 4).count() == moved
    sharding.grow(spark, path, 6, 7)
    again = {r["doc_id"]: r["shard"] for r in sharding.read(spark, path, 7).collect()}
    assert again == {i: brute_jump(key_of(i), 7) for i in range(400)}
    with pytest.raises(ValueError):
        sharding.grow(spark, path, 7, 7)
