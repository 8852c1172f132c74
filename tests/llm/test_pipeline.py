"""The pipeline against stages written anew in plain Python, and the registered queries' contracts."""

import hashlib
import zlib

import numpy as np

import __spark_entry__ as E
import corpus_pipeline as C
from pagelake.llm import disclosure, mixing, tokens
from pagelake.llm.common import documents, written
from tests.llm import odd
from tests.llm.test_mixing import level_by_rounds
from tests.llm.test_quality_rules import WORD
from tests.llm.test_quality_rules import brute as rule_brute
from tests.llm.test_simhash import brute_print, brute_roots

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Quality rules, then one document of each SimHash group."""
    rows = [r for r in rows if rule_brute(r["text"])[-1]]
    prints = [brute_print(r["text"]) for r in rows]
    roots = brute_roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        least[roots[p]] = min(r["doc_id"], least.get(roots[p], r["doc_id"]))
    return [r for r, p in zip(rows, prints, strict=True) if least[roots[p]] == r["doc_id"]]


def test_pipeline_matches_plain_python(spark):
    rows = [r.asDict() for r in documents(spark, SF).collect()]
    kept = {r["doc_id"]: r for r in brute_kept(rows)}
    docs = documents(spark, SF)
    for name, stage in C.STAGES[:3]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    clean = {r["doc_id"]: r for r in docs.collect()}
    assert set(clean) == set(kept)
    terms = {r["doc_id"]: [tuple(t) for t in r["terms"] or []] for r in disclosure.detect(spark.createDataFrame(
        [(r["doc_id"], r["text"]) for r in kept.values()], "doc_id bigint, text string")).collect()}
    for i, r in clean.items():
        assert r["text"] == disclosure.redact(kept[i]["text"], terms[i]) and r["n_chars"] == len(r["text"])
        assert disclosure.base_spans(r["text"]) == []

    # the mix: whole copies, near the targets
    mixed = written(C.STAGES[3][1](spark, docs, SF), "test")
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.select("doc_id").collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    size = {i: len(WORD.findall(r["text"])) for i, r in clean.items()}
    sources = sorted({r["source"] for r in clean.values()})
    own = {s: [i for i, r in clean.items() if r["source"] == s] for s in sources}
    target = level_by_rounds([sum(size[i] for i in own[s]) for s in sources], [(5, 2, 1)[j % 3] for j in range(len(sources))])
    for s, t in zip(sources, target, strict=True):
        taken = sum(copies.get(i, 0) * size[i] for i in own[s])
        assert abs(taken - t) <= max(0.1 * t, max(size[i] for i in own[s]))
        assert all(copies.get(i, 0) <= 3 for i in own[s])

    # the last stage: every copy whole, in full sequences
    packed = C.STAGES[4][1](spark, mixed, SF).collect()
    enc = tokens.ChunkEncoder(tokens.default_tokenizer())
    got, seqs = {}, {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.array([*enc.tokenizer.encode(clean[r["doc_id"]]["text"], add_special_tokens=False).ids, 2], "<u4")
        assert bytes(r["ids"]) == ids[r["start"]:r["start"] + r["length"]].tobytes()
    for i, n in copies.items():
        assert got[i] == n * (len(enc.encode(clean[i]["text"])) + 1)
    for held in seqs.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(seqs) <= 1.03 * sum(got.values()) / 1024 + 1


def test_run_returns_the_last_stage(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"] and out.count() > 100


def test_stages_take_odd_and_empty_tables(spark):
    for df in (odd.storable(odd.docs(spark)), odd.storable(odd.empty(spark))):
        docs = df
        for name, stage in C.STAGES:
            docs = written(stage(spark, docs, SF), "test")
            assert name == C.STAGES[-1][0] or docs.columns == df.columns
        assert docs.count() >= 0


def test_registered_names():
    names = set(E.queries())
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")}
    assert {"op3_quality_rules", "op6_mix_sources"} <= set(E.oracle_sql())


def test_digest_queries(spark):
    q = E.queries()
    enc = tokens.ChunkEncoder(tokens.default_tokenizer())
    rows = sorted(documents(spark, SF).collect(), key=lambda r: r["doc_id"])
    ids = {r["doc_id"]: enc.encode(r["text"] or "").tolist() for r in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())

    at = 0
    got = {r["doc_id"]: r for r in q["op10_token_output"](spark, SF).collect()}
    for r in rows:
        want = [*ids[r["doc_id"]], 0]
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], at, len(want), crc(want))
        at += len(want)

    for r in q["op4_pack_sequences"](spark, SF).collect():
        assert r["ids_crc32"] == crc([*ids[r["doc_id"]], 2][r["start"]:r["start"] + r["length"]])

    marks = {r["doc_id"]: r for r in q["op9_personal_data"](spark, SF).collect()}
    for r in rows:
        spans = disclosure.base_spans(r["text"] or "")
        m = marks[r["doc_id"]]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert m["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and m["spans"].startswith(base)
        assert [m[f"n_{k}"] for k in disclosure.KINDS] == [sum(x[0] == k for x in spans) for k in disclosure.KINDS]

    prints = {r["doc_id"]: r["fingerprint"] for r in q["op2_simhash_groups"](spark, SF).collect()}
    assert prints == {r["doc_id"]: f"{brute_print(r['text']):016x}" for r in rows}
    assert q["op6_mix_sources"](spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert mixing.MAX_REPEATS == 3
