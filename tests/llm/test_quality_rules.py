import re
from collections import Counter

from pagelake.llm import quality_rules as Q
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stop = set(Q.STOP_WORDS)
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(Q.SYMBOLS, text)),
         "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    ratio = lambda a, b: a / b if b else 0.0
    r = {"n_words": len(w), "mean_word_chars": ratio(m["word_chars"], len(w)), "symbol_ratio": ratio(m["n_symbols"], len(w)),
         "stop_ratio": ratio(sum(x.lower() in stop for x in w), len(w)), "dup_line_ratio": ratio(m["n_dup_lines"], len(lines)),
         "bullet_line_ratio": ratio(sum(bool(re.match("[-*•]", x.lstrip(" "))) for x in lines), len(lines)),
         "ellipsis_line_ratio": ratio(sum(x.rstrip(" ").endswith(("...", "…")) for x in lines), len(lines))}
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    ok = all((x.low is None or r[x.measure] >= x.low) and (x.high is None or r[x.measure] <= x.high) for x in Q.RULES)
    return (*m.values(), base, not base and ok)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_matches_brute_force_on_odd_documents(spark):
    got = Q.judge(odd.docs(spark)).select("doc_id", *COLUMNS).collect()
    want = [(r[0], *brute(r[1])) for r in odd.rows()]
    assert _sorted(map(tuple, got)) == _sorted(want)


def test_rules_see_symbols_lines_and_stop_words(spark):
    body = " ".join(f"word{i} the of" for i in range(40))
    texts = [body, body.replace(" ", "### "), "\n".join(["- " + x for x in body.split(" ")]), "\n".join([x + " ..." for x in body.split(" ")]),
             " ".join(f"zz{i}q" for i in range(99)), "\n".join([body] * 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in Q.judge(df).collect()}
    assert [got[i]["kept"] for i in range(6)] == [brute(t)[-1] for t in texts] == [True, False, False, False, False, False]
    assert got[1]["failed_rules"] == ["symbols_per_word", "stop_words_per_word"]
    assert "bullet_lines" in got[2]["failed_rules"] and "ellipsis_lines" in got[3]["failed_rules"]


def test_keep_passes_rows_through(spark):
    df = odd.docs(spark)
    kept = Q.keep(df)
    assert kept.columns == df.columns
    want = [r for r in odd.rows() if brute(r[1])[-1]]
    assert _sorted(tuple(r) for r in kept.collect()) == _sorted(want)


def test_empty_table(spark):
    assert Q.judge(odd.empty(spark)).count() == 0
    assert Q.keep(odd.empty(spark)).collect() == []


def test_no_user_function_in_the_plan(spark):
    plan = Q.judge(odd.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
