import random
import re

from pagelake.llm import disclosure as D
from tests.llm import odd

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 13 <= len(digits) <= 19 and D.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns_match_the_plain_expressions_on_random_texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "_", "%", "+", " ", "1", "12", "255", "256", "4", "(", ")", "\n", "é", "٣", "４",
             "4111111111111111", "+1 (555) 010-9999", "1.2.3.4", "000255.1.1.1", "@@", "mail@host"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert D.base_spans(text) == naive(text), text


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000):
        D.base_spans(text)


def corpus(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("bar", "lom", "tir", "vek") for b in ("an", "or", "il") for c in ("da", "mu", "se")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    for i in range(6):  # the name is only ever seen beside this address, in different contexts
        filler = [rng.choice(words) for _ in range(20)]
        rows.append((500 + i, " ".join(filler[:10]) + " Zanthippe bluehat@corp.example.org " + " ".join(filler[10:])))
    copy = "barquell lommic tirvan someone@copy.example.org unusual"
    rows += [(600 + i, copy) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_terms_that_give_an_entity_away(spark):
    df = corpus(spark)
    found = D.written(D.find(df), "test")
    pairs = {(r["entity"], r["term"]): r["revealed"] for r in D.disclosing(df, found).collect()}
    # common words reveal little; words of one text copied five times have one context only
    assert pairs == {("email:bluehat@corp.example.org", "zanthippe"): 1.0}
    marked = {r["doc_id"]: r for r in D.detect(df).collect()}
    for i in range(6):
        text = df.where(f"doc_id = {500 + i}").first()["text"]
        assert [text[t["start"]:t["end"]] for t in marked[500 + i]["terms"]] == ["Zanthippe"]
    assert marked[600]["terms"] is None and len(marked[600]["spans"]) == 1
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(df).collect()}
    assert "Zanthippe" not in clean[503] and "[EMAIL]" in clean[503] and "bluehat" not in clean[503]
    assert clean[0] == df.where("doc_id = 0").first()["text"]
    softer = {r["doc_id"]: r["text"] for r in D.sanitise(df, remove_at=1.1).collect()}
    assert "[NAME] [EMAIL]" in softer[503]


def test_copies_count_once_on_both_sides(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("bar", "lom", "tir", "vek") for b in ("an", "or", "il", "ud")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(400)]
    for i in range(6):
        rows += [(1000 + 100 * i + k, f"{words[i]} {words[i + 1]} Zanthippe bluehat@corp.example.org {words[i + 2]}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = D.written(D.find(df), "test")
    for limit in (D.BROADCAST_COPIED, 0):
        monkeypatch.setattr(D, "BROADCAST_COPIED", limit)
        got = {(r["entity"], r["term"]): r["revealed"] for r in D.disclosing(df, found).collect()}
        assert got == {("email:bluehat@corp.example.org", "zanthippe"): 1.0}


def test_terms_far_from_the_address_and_in_other_texts(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("bar", "lom", "tir", "vek") for b in ("an", "or", "il", "ud")]
    far = lambda: " ".join(rng.choice(words) for _ in range(200))
    # seen once beside its entity: a word of its own is enough among many texts
    rows = [(i, f"{rng.choice(words)} {i}") for i in range(3000)] + [(5000, f"Quillon {far()} single@corp.example.org {far()} Quillon")]
    rows += [(6000 + i, f"Zanthippe {far()} {i} bluehat@corp.example.org {far()} zanthippe") for i in range(30)]
    rows += [(7000, f"ask Zanthippe {far()}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = dict(rows)
    for limit in (D.SENT_TERMS, 0):
        monkeypatch.setattr(D, "SENT_TERMS", limit)
        got = {r["doc_id"]: [text[r["doc_id"]][t["start"]:t["end"]] for t in r["terms"]] for r in D.detect(df).where("terms is not null").collect()}
        assert got == {5000: ["Quillon", "Quillon"], 7000: ["Zanthippe"], **{6000 + i: ["Zanthippe", "zanthippe"] for i in range(30)}}


def test_many_terms_are_joined_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(D, "SENT_TERMS", 0)
    df = corpus(spark)
    found = D.written(D.find(df), "test")
    assert [(r["term"], r["revealed"]) for r in D.disclosing(df, found).collect()] == [("zanthippe", 1.0)]


def test_more_clean_texts_mark_no_more_words(spark):
    """A word of one text with the value and of several without it stays, however large the corpus."""
    marked = {}
    for n in (3_000, 40_000):
        beside = [(i, "plain words here ursine lantern") for i in range(6)]
        rows = [(100 + i, f"filler{i} text number{i} runs on") for i in range(n)]
        rows += [(90, "ursine lonelyword someone@place.example.org")]
        rows += [(i, f"{t} v{chr(97 + i)}{chr(97 + i)}{chr(97 + i)}") for i, t in beside]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        text = rows[n][1]
        hits = {r["doc_id"]: [text[t["start"]:t["end"]] for t in r["terms"]] for r in D.detect(df).collect() if r["terms"]}
        assert set(hits) <= {90} and "ursine" not in hits.get(90, [])
        marked[n] = hits
    assert marked[40_000] == {90: ["lonelyword"]}


def test_overlapping_spans_are_redacted_once():
    text = "call +1.2.3.4 99999 or 4111 1111 1111 1111 x"
    out = D.redact(text, [])
    assert "4111" not in out and out.startswith("call [PHONE]")


def test_odd_documents(spark):
    df = odd.docs(spark)
    got = {(r["doc_id"], len(r["spans"])) for r in D.detect(df).collect()}
    assert (12, 1) in got and sum(n for _, n in got) == 1
    clean = D.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(odd.rows())
    want = sorted(((r[0] or 0), None if r[1] is None else r[1].replace("me@x.example.org", "[EMAIL]")) for r in odd.rows() if r[0])
    assert sorted((r["doc_id"], r[1]) for r in clean.collect() if r["doc_id"]) == want
    assert D.detect(odd.empty(spark)).count() == 0 and D.sanitise(odd.empty(spark)).count() == 0
