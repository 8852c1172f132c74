import hashlib
import random

from pagelake.llm import fingerprints as P
from tests.llm import odd


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_likeness_estimates_the_share_of_common_shingles():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    errors = []
    for n in (8, 40, 300, 2000) * 12:
        a = [rng.choice(words) for _ in range(n)]
        keep = rng.randint(0, n)
        b = a[:keep] + [rng.choice(words) for _ in range(n - keep)]
        errors.append(P.likeness(P.fingerprint(" ".join(a)), P.fingerprint(" ".join(b))) - jaccard(" ".join(a), " ".join(b)))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.13


def test_equal_and_unlike_texts():
    assert P.likeness(P.fingerprint(""), P.fingerprint(" \n")) == 1.0
    assert P.likeness(P.fingerprint("a"), P.fingerprint("a")) == 1.0
    assert P.likeness(P.fingerprint("a"), P.fingerprint("b")) < 0.1
    assert len(P.fingerprint("x")) == P.BINS * P.BITS // 8


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + following[:half]
        own = P.fingerprint(text)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), P.fingerprint(new).hex(),
                    P.likeness(own, P.fingerprint(new)), P.likeness(own, P.fingerprint(following))))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_every_document_meets_the_next_one_across_ranges(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 60)))) for i in range(200)]
    for data in (rows, [(r[0], r[1]) for r in odd.rows()], rows[:1]):
        for parts in ("1", "7"):
            old = spark.conf.get("spark.sql.shuffle.partitions")
            coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            try:
                df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
                got = P.with_next(df).collect()
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", old)
                spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            assert sorted(map(tuple, got), key=key) == sorted(brute(data), key=key)


def test_no_documents(spark):
    assert P.with_next(odd.empty(spark)).count() == 0
