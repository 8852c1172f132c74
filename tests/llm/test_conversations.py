"""Conversation repair against every edit there is, against SQL, and over segments."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from pagelake.llm import conversations as C
from pagelake.llm.queries import op12_repair_conversations
from pagelake.llm.sql import ORACLE

SCHEMA = "conv_id bigint, turn bigint, role string, text string, CONV_ID string, cost string, `a.b` string, part string"
EXTRA = ("x", "y", "z", "w")
ROLES = ["system", "user", "assistant", "tool", "", None, "useful"]
TEXTS = ["Yes.", "no", "Why?  ", " \t", "", None, "a\nb!", "x."]


def brute_edits(rows):
    """Cost, audit and lines of the best edit by trying all; at most two insertions in a place."""
    seen, kinds = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        gone = blank or (role, text) in seen
        seen.add((role, text))
        kinds.append((role, text, gone, not gone and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)))
    added = [("I", 2, f"{r}:") for r in ("user", "assistant")]
    gaps = [list(g) for n in range(3) for g in itertools.product(added, repeat=n)]
    choices = [gaps]
    for role, text, gone, cut in kinds:
        own = [[("D", 3, None)]]
        if not gone:
            own += [[("K", cut, f"{role}:{text}")], *([("R", 2 + cut, f"{r}:{text}")] for r in ("user", "assistant"))]
        choices += [own, gaps]
    best = None
    for picked in itertools.product(*choices):
        steps = [s for part in picked for s in part]
        lines = [s[2] for s in steps if s[2] is not None]
        if re.fullmatch("(s?(ua)+)?", "".join(line[:1] if line[:1] != ":" else "-" for line in lines)):
            found = (sum(s[1] for s in steps), "".join(s[0] for s in steps), "\n".join(lines))
            best = found if best is None or found[:2] < best[:2] else best
    return best


def test_weights_find_the_best_of_all_edits():
    rng = random.Random(3)
    for _ in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "no", " ", "x."])) for _ in range(rng.choice([0, 1, 2, 2]))]
        seen, shapes = set(), []
        for role, text in rows:
            gone = not text.strip() or (role, text) in seen
            seen.add((role, text))
            cut = text == "no"
            initial = role[0] if role[0] in "sua" else "-"
            shapes.append("x" if gone else "+" if cut and initial == "-" else initial.upper() if cut else initial)
        want = brute_edits(rows)
        for size in (1, 2, 5):
            parts = ["".join(shapes[i:i + size]) for i in range(0, len(shapes), size)]
            assert C.cheapest([[C.segment_paths(p, s) for s in range(4)] for p in parts]) == want[:2], rows


def test_segments_of_any_size_agree_on_a_long_conversation():
    rng = random.Random(5)
    shapes = "".join(rng.choice("sSuUaA-+x") for _ in range(700))
    whole = C.cheapest([[C.segment_paths(shapes, s) for s in range(4)]])
    for size in (1, 7, 256):
        parts = [shapes[i:i + size] for i in range(0, len(shapes), size)]
        assert C.cheapest([[C.segment_paths(p, s) for s in range(4)] for p in parts]) == whole


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def brute_table(rows):
    """The contract's columns for rows after damage, ``(conv_id, turn, role, text)``, with turns distinct or rows equal."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        own = [(t, " " if role is None else role, " " if text is None else text) for _, t, role, text in own]
        pairs = [(r, x) for _, r, x in own]
        blank = [not re.search(r"[^\x20\x09-\x0D]", x) for _, x in pairs]
        dup = [not b and p in pairs[:i] for i, (p, b) in enumerate(zip(pairs, blank, strict=True))]
        cut = [not b and not d and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", x) for (_, x), b, d in zip(pairs, blank, dup, strict=True)]
        legal = [a[:1] + b[:1] in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False)]
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = brute_edits(pairs)
        out[conv] = (gaps, sum(blank), sum(dup), sum(cut), len(legal) - sum(legal), cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [1, 2, 1024])
def test_tables_match_brute_force(spark, segment):
    rng = random.Random(segment)
    rows = []
    for conv in [None, 0, 1, 2, 3, 4, 5, 6, 7]:
        turns = sorted(rng.sample(range(9), 2))
        own = [(conv, t, rng.choice(ROLES), rng.choice(TEXTS)) for t in turns]
        rows += own + ([own[0]] if rng.random() < 0.4 else [])
    rows += [(8, None, "user", "Yes."), (8, None, "user", "Yes."), (8, 3, "assistant", "Ok.")]
    got = {r[0]: tuple(r)[1:] for r in C.repair(table(spark, rows), segment=segment).collect()}
    assert got == brute_table(rows)


def test_repaired_rows_are_what_the_digest_covers(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U" * 300_000), (1, 3, "user", ""), (2, 0, "tool", "T.")]
    made = {}
    for r in sorted(C.repaired_rows(table(spark, rows)).collect(), key=lambda r: (r["conv_id"], r["position"])):
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in C.repair(table(spark, rows)).collect()}
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in made.items()} == {
        c: d for c, d in digests.items() if d != hashlib.sha256(b"").hexdigest()}
    for x in made.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in x))


def sql(con_rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", con_rows)
    return sorted(con.sql(ORACLE["op12_repair_conversations"]).fetchall(), key=repr)


def test_damage_and_repair_match_sql_with_one_conversation_of_a_third_of_the_rows(spark):
    rng = random.Random(11)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "x.", f"t{t}."])) for t in range(200)]
    for conv in range(100, 160):
        rows += [(conv, t, rng.choice(ROLES), rng.choice(TEXTS)) for t in range(rng.randint(1, 8))]
    rows += [(None, None, None, None), (200, None, "user", "Hi.")]
    for segment in (16, 1024):
        got = C.repair_damaged(table(spark, rows), segment=segment)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sql(rows)


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b") for c in range(12) for t in range(6)]
    got = sorted((tuple(r) for r in C.damaged(table(spark, rows)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else "A b" if fault == 2 else text)
        want += [] if fault == 0 else [row, row] if fault == 3 else [row]
    assert got == sorted(want, key=repr) and len(got) != len(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_damaged(empty).collect() == [] and C.repair(empty).collect() == [] and C.repaired_rows(empty).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted((tuple(r) for r in op12_repair_conversations(spark, sf).collect()), key=repr) == sql(rows)
