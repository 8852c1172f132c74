import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelake.llm import simhash as S
from pagelake.llm.components import components
from tests.llm import odd


def brute_print(text, size=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints_match_brute_force(spark):
    got = S.fingerprints(odd.docs(spark)).select("doc_id", S.hex_digits(F.col("fp")).alias("h")).collect()
    want = sorted((r[0] is None, r[0] or 0, f"{brute_print(r[1]):016x}") for r in odd.rows())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["h"]) for r in got) == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("max_bits,blocks,hot", [(4, 7, 512), (4, 7, 2), (4, 5, 512), (4, 9, 3), (3, 6, 2), (2, 5, 1), (0, 1, 512), (1, 4, 1)])
def test_links_connect_exactly_the_pairs_within_distance(spark, max_bits, blocks, hot):
    rng = random.Random(max_bits * 100 + blocks)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 7)):
            prints.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
    ball = rng.getrandbits(64)
    prints |= {ball ^ sum(1 << b for b in rng.sample(range(0, 64, 3), rng.randint(0, 3))) for _ in range(40)}
    nodes = sorted(signed(p) for p in prints)
    df = spark.createDataFrame([(n,) for n in nodes], "fp bigint")
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for finer in ((), (12,), (8, 13)) if hot < 512 else ((12,),):  # crowded buckets linked at once, or split again first
        links = S.links(df, max_bits, blocks, hot, finer).collect()
        assert all(distance(r["u"], r["v"]) <= max_bits for r in links)
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
        assert {n: got.get(n, n) for n in nodes} == brute_roots(nodes, lambda a, b: distance(a, b) <= max_bits)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(50)}, 300: 299}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def near_copies():
    rng = random.Random(5)
    base = [f"word{rng.randint(0, 3000)}" for _ in range(600)]
    out = []
    for i in range(30):
        copy = list(base)
        copy[rng.randrange(600)] = f"edit{i}"
        out.append((i, " ".join(copy)))
    return out + [(100 + i, " ".join(f"other{rng.randint(0, 3000)}" for _ in range(50))) for i in range(10)]


def test_groups_match_brute_force(spark):
    data = near_copies() + [(r[0], r[1]) for r in odd.rows()]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    prints = [brute_print(t) for _, t in data]
    roots = brute_roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), p in zip(data, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    for hot in (512, 3):
        got = S.groups(df, hot=hot).select("doc_id", "text_md5", "component_id").collect()
        want = [(i, least.get(roots[p])) for (i, _), p in zip(data, prints, strict=True)]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def test_keep_one_of_each_group(spark):
    df = odd.docs(spark)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # 5, 11 (twice) and the null id share a text; 7, 8, 9 and the other null id have no words
    assert sorted(i for i in ids if i is not None) == [5, 7, 10, 12, 13, 14, 15] and None not in ids
    assert S.keep_one(odd.empty(spark)).count() == 0
    assert S.groups(odd.empty(spark)).count() == 0


def test_shingles_of_few_words():
    assert len(S.shingle_hashes("", 4)) == 0 and len(S.shingle_hashes("a b", 4)) == 1 and len(S.shingle_hashes("a b c d e", 4)) == 2
    assert S.fingerprint_of(np.array([], "uint64")) == 0
