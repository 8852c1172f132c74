"""Plain-Python statements of the rules, used as brute-force references in tests."""

import re

MASK = [r"(?s)<nowiki>.*?</nowiki>", r"<!--.*?-->", r"(?s)<ref>.*?</ref>", r"(?s)<code>.*?</code>",
        r"(?s)<noinclude>.*?</noinclude>", r"(?s)<includeonly>.*?</includeonly>"]


def mask(text):
    if text is None:
        return None
    b = bytearray(text.encode())
    for p in MASK:
        for m in re.finditer(p, text):
            s, e = len(text[:m.start()].encode()), len(text[:m.end()].encode())
            b[s:e] = b" " * (e - s)
    return b.decode()


def categories(masked):
    out = []
    for c in re.findall(r"\[\[Category:([^|\]]*)", masked):
        c = c.strip(" \r\n\t")
        if "\n" in c:
            continue
        out.append(re.sub("  +", " ", c))
    return out


def purchase_fold(balance, costs):
    ok = []
    for c in costs:
        if c <= balance:
            balance -= c
            ok.append(True)
        else:
            ok.append(False)
    return ok, balance


def greedy_packs(ranges, limit):
    base = ranges[0][0]
    starts = {base}
    for st, ed in ranges:
        if ed - base > limit:
            base = ed
            starts.add(ed)
    return starts


def bfs(cate_links, root, rounds=5):
    """cate_links: list of (title, [parents]) rows."""
    seen = {root}
    level = [t for t, ps in cate_links if root in ps]
    seen.update(level)
    levels = [level]
    for _ in range(rounds):
        prev = set(levels[-1])
        nxt = [t for t, ps in cate_links if t not in seen and any(p in prev for p in ps)]
        seen.update(nxt)
        levels.append(nxt)
    return levels
