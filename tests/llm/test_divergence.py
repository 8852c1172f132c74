"""The source audit against plain Python, with digests so short that terms share them."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb
import pytest

from pagelake.llm import divergence as D
from pagelake.llm.queries import op13_source_divergence
from pagelake.llm.sql import ORACLE
from tests.llm import odd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, ranks=10):
    """``rows`` are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [TERM.findall(t.translate(LOWER)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, total, own = Counter(), Counter(), {}
        for (la, source, _), w in zip(rows, words, strict=True):
            if la == lang:
                df.update(set(w))
                total.update(w)
                own.setdefault(source, Counter()).update(w)
        kept = [t for t, n in df.items() if n >= min_docs]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + floor(Fraction(1_000_000_000 * (counts[t] + 2), n + 2 * len(kept))) for t in kept}

        def far(p, q):
            return (p - q) * (p - q) // (p + q)

        of_lang, of_source = shares(total), {s: shares(c) for s, c in own.items()}
        for source, p in of_source.items():
            pairs = [(-sum(far(p[t], q[t]) for t in kept), other.encode()) for other, q in of_source.items() if other != source]
            terms = [(-far(p[t], of_lang[t]), t.encode()) for t in kept if own[source][t] > 0 and p[t] > of_lang[t]]
            for part, found, last in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:last])]
    return sorted(out)


def rows_of(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Été", "été", "ÉTÉ", "naïve", "日本", "x9y"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None, "d"])
        cut = vocabulary[:30] if source == "b" else vocabulary[rng.randrange(40):]
        rows.append((lang, source, rng.choice([" ", "-", "\n", "_9"]).join(rng.choice([str, str.upper])(rng.choice(cut)) for _ in range(rng.randint(0, 25)))))
    return rows + [("fr", "a", "un"), ("fr", "b", None), ("es", "z", ""), ("en", "a", "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0, *odd.EXTRA) for i, (la, s, t) in enumerate(rows)], odd.SCHEMA).repartition(4)


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_matches_plain_python_even_if_terms_share_digests(spark, bits):
    rows = rows_of(bits)
    got = D.audit(frame(spark, rows), digest_bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_ties_take_the_least_item(spark):
    rows = [("en", s, " ".join(f"t{chr(97 + i)}" for i in range(26)) + (" own" if s == "a" else "")) for s in "ab" for _ in range(12)]
    got = sorted(map(tuple, D.audit(frame(spark, rows)).collect()))
    assert got == brute(rows) and [r[3] for r in got if r[1] == "b" and r[2] == "term"] == [f"t{chr(97 + i)}" for i in range(10)]


def test_counts_pass_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD_WORDS", 3)
    monkeypatch.setattr(D, "HELD_RECORDS", 5)
    monkeypatch.setattr(D, "RANGE_DOCS", 1)
    rows = rows_of(9, 60)
    assert sorted(map(tuple, D.audit(frame(spark, rows), min_docs=3).collect())) == brute(rows, 3)


def test_odd_rows_and_empty_tables(spark):
    rows = [(r[2], r[3], r[1]) for r in odd.rows()]
    assert sorted(map(tuple, D.audit(odd.docs(spark), min_docs=2).collect())) == brute(rows, 2)
    assert D.audit(odd.empty(spark)).collect() == []


def test_query_equals_sql_and_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op13_source_divergence(spark, sf).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.sql(ORACLE["op13_source_divergence"]).fetchall())
    assert got == brute([(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
