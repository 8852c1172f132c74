"""Personal data: patterns, and terms that give a protected value away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Every
value found is a protected entity; all words of the texts that hold it are its
context terms.  How much of the entity a term reveals is its pointwise mutual
information over the information content of the entity, both from corpus
counts of distinct texts: with ``n`` of them, ``log2(n * p(entity | term) /
n(entity)) / log2(n / n(entity))``, 1 if the term occurs with this entity only.
There is no least support: few texts make ``p`` uncertain, so a term discloses
an entity if it reveals ``generalise_at`` of it even at the lower end of
Wilson's interval for ``p``, and that lower end is ``SHARE_AT`` or more: what a
term reveals grows with ``n``, but a term mostly seen without the entity never
gives it away, however large the corpus.  Such a term is replaced by its class, or removed
if it reveals ``remove_at``, wherever it occurs: in all texts, with the entity
or without it.  Copies of one text count once, so a text copied many times does
not make its own words suspicious.

Entities that occur in the very same texts have the same counts; they are one
class, so a list of a thousand addresses costs no more than one address.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; null ids pass through; an empty table gives an empty result; other
columns are ignored or passed through by position, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import apart, by_key, map_texts, pick, written

# The kinds in their order and the patterns that define them.
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_TAIL = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# End of the fixed values.

TERM = "term"
CONFIDENCE = 1.96
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
# The least share of a term's texts, at the lower end of its interval, that must hold the entity.
SHARE_AT = 0.2
# Up to this many distinct terms are sent to the tasks that count documents; more are joined.
SENT_TERMS = 100_000
# Up to this many digests of copied texts are sent to the tasks; more are joined.
BROADCAST_COPIED = 200_000
# Counts of terms kept by a task before it passes them on.
_HELD_COUNTS = 300_000
_BATCH_CHARS = 1_000_000

_tail, _ip, _card, _phone = (re.compile(p) for p in (EMAIL_TAIL, IP, CARD, PHONE))
_word = re.compile(r"[^\W\d_]{3,}")
_not_digit = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards: linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        tail = _tail.match(text, at) if start < at else None
        if tail:
            floor = tail.end()
            out.append((start, floor))
        at = text.find("@", max(at + 1, floor))
    return out


def _octets(match: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in match.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if _octets(m.group())]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _not_digit.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_not_digit.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entity_of(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _not_digit.sub('', value)}"


def places(text: str, spans: list[tuple[str, int, int]], wanted: Container[str] | None = None) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` of all words, or of those in ``wanted``, that no span touches."""
    taken = sorted((a, b) for _, a, b in spans)
    out, i, reach = [], 0, 0
    for m in _word.finditer(text):
        start, end = m.span()
        # spans that begin before the word ends; the furthest of them must not reach into it
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= start and (wanted is None or m.group().lower() in wanted):
            out.append((m.group().lower(), start, end))
    return out


_FOUND = """spans array<struct<kind:string,start:int,end:int>>, entities array<string>,
terms array<struct<term:string,start:int,end:int>>"""
_CLASS = ["n_entity", "class_a", "class_b"]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_md5, spans, entities, terms)``: base spans, and where there are any, all terms with their places."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("text_md5", F.md5(F.col("text")))

    def run(texts: list[str]) -> dict:
        spans = [base_spans(t) for t in texts]
        both = list(zip(texts, spans, strict=True))
        return {"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans],
                "entities": [sorted({entity_of(k, t[a:b]) for k, a, b in s}) for t, s in both],
                "terms": [[{"term": w, "start": a, "end": b} for w, a, b in places(t, s)] if s else [] for t, s in both]}

    return map_texts(d, "text", _FOUND, run, _BATCH_CHARS)


def _once(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """``(text, text_md5, weight)``: the weights of the copies of a text sum to 1, so that sums count distinct texts."""
    d = pick(docs, text=text_col).where("text is not null").withColumn("text_md5", F.md5(F.col("text")))
    copied = written(found.groupBy(F.col("text_md5").alias("md5")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copied")
    few = copied.limit(BROADCAST_COPIED + 1).count() <= BROADCAST_COPIED
    d = d.join(F.broadcast(copied) if few else by_key(copied), d["text_md5"] == copied["md5"], "left")
    return d.select("text", "text_md5", (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("weight"))


def _document_counts(docs: DataFrame, found: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """``(term, df)``: distinct texts that hold each of ``terms``."""
    n_terms = terms.count()
    wanted = frozenset(r["term"] for r in terms.collect()) if n_terms <= SENT_TERMS else None

    def rows(counts: dict[str, float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()),
                                           "part": pa.array(list(counts.values()), pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, float] = {}
        for batch in batches:
            for text, weight in zip(batch.column("text"), batch.column("weight").to_pylist(), strict=True):
                held = {w.lower() for w in _word.findall(text.as_py())}
                for term in held if wanted is None else held & wanted:
                    counts[term] = counts.get(term, 0.0) + weight
                if len(counts) > _HELD_COUNTS:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    counted = _once(docs, found, text_col).select("text", "weight").mapInArrow(run, "term string, part double")
    counted = counted.groupBy("term").agg(F.round(F.sum("part")).cast("bigint").alias("df"))
    return counted.join(by_key(terms, n_terms), "term", "left_semi") if wanted is None else counted


def _held(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with their classes, the classes in each distinct text, and the terms of each with their places."""
    one = written(found.where(F.size("entities") > 0).select("text_md5", "entities", "terms").dropDuplicates(["text_md5"]), "texts")
    member = one.select("text_md5", F.explode("entities").alias("entity"))
    # entities of one class: as many texts, and equal digests of the set of texts
    classes = written(member.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), F.bit_xor(F.xxhash64("text_md5")).alias("class_a"),
        F.bit_xor(F.xxhash64("text_md5", F.lit(1))).alias("class_b")), "classes")
    within = written(by_key(member).join(classes, "entity").select("text_md5", *_CLASS).distinct(), "within")
    return classes, within, one.select("text_md5", F.explode("terms").alias("t")).select("text_md5", "t.*")


def _revealed(share: Column, n: int) -> Column:
    return F.log2(share * n / F.col("n_entity")) / F.log2(F.lit(float(n)) / F.col("n_entity"))


def _lower(k: Column, m: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a share of which ``k`` of ``m`` cases are known."""
    p, zz = k / m, z * z
    return (p + zz / (2 * m) - z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))) / (1 + zz / m)


def _disclosing(docs: DataFrame, found: DataFrame, held: tuple[DataFrame, DataFrame, DataFrame], text_col: str,
                generalise_at: float, confidence: float) -> DataFrame:
    """``term, revealed, n_both, df`` and the class, for terms that disclose the entities of the class."""
    _, within, terms = held
    n = found.select("text_md5").distinct().count()
    pairs = within.where(F.col("n_entity") < n).join(by_key(terms.select("text_md5", "term").distinct()), "text_md5")
    pairs = pairs.groupBy(*_CLASS, "term").agg(F.count(F.lit(1)).alias("n_both"))
    # what is not enough if no other text holds the term is never enough
    best = _revealed(_lower(F.col("n_both"), F.col("n_both"), confidence), n)
    pairs = written(pairs.where(best >= generalise_at), "pairs")
    counts = _document_counts(docs, found, written(pairs.select("term").distinct(), "terms"), text_col)
    p = by_key(pairs, pairs.count()).join(counts.withColumnRenamed("term", "counted"), F.col("term") == F.col("counted")).drop("counted")
    df = F.greatest("n_both", "df")
    p = p.withColumn("revealed", _revealed(F.col("n_both") / df, n))
    least = _lower(F.col("n_both"), df, confidence)
    return p.where((_revealed(least, n) >= generalise_at) & (least >= SHARE_AT))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", generalise_at: float = GENERALISE_AT,
               confidence: float = CONFIDENCE) -> DataFrame:
    """``(entity, term, revealed)`` for terms that reveal ``generalise_at`` of an entity or more, with ``confidence``."""
    held = _held(found)
    return _disclosing(docs, found, held, text_col, generalise_at, confidence).join(held[0], _CLASS).select("entity", "term", "revealed")


def _elsewhere(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """``(text_md5, start, end, revealed)``: places of ``terms`` in all texts."""
    few = terms.count() <= SENT_TERMS
    wanted = frozenset(r["term"] for r in terms.select("term").collect()) if few else None
    d = pick(docs, text=text_col).where("text is not null").select("text", F.md5("text").alias("text_md5"))

    def run(texts: list[str]) -> dict:
        out = []
        for t in texts:
            some = wanted is None or any(w.lower() in wanted for w in _word.findall(t))
            out.append([{"term": w, "start": a, "end": b} for w, a, b in places(t, base_spans(t), wanted)] if some else [])
        return {"terms": out}

    t = map_texts(d, "text", "terms array<struct<term:string,start:int,end:int>>", run, _BATCH_CHARS)
    t = t.select("text_md5", F.explode("terms").alias("t")).select("text_md5", "t.*").distinct()
    return t.join(F.broadcast(terms) if few else by_key(terms), "term").select("text_md5", "start", "end", "revealed")


def term_spans(docs: DataFrame, found: DataFrame, text_col: str = "text", remove_at: float = REMOVE_AT,
               generalise_at: float = GENERALISE_AT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(text_md5, terms)``: places of disclosing terms per distinct text, in order, marked to remove or not."""
    held = _held(found)
    told = written(_disclosing(docs, found, held, text_col, generalise_at, confidence), "told")
    _, within, terms = held
    near = by_key(terms.select("text_md5", "term").distinct()).join(within, "text_md5")
    near = near.join(by_key(told, told.count()), [*_CLASS, "term"])
    near = near.groupBy("text_md5", "term").agg(F.max("revealed").alias("revealed"))
    t = by_key(terms).join(near, ["text_md5", "term"]).select("text_md5", "start", "end", "revealed")
    # only terms that more texts hold than hold them with the entity can be in a text without it
    beyond = written(told.where("df > n_both").groupBy("term").agg(F.max("revealed").alias("revealed")), "beyond")
    if not beyond.isEmpty():
        t = t.unionByName(_elsewhere(docs, beyond, text_col))
    t = t.groupBy("text_md5", "start", "end").agg(F.max("revealed").alias("revealed"))
    place = F.struct("start", "end", (F.col("revealed") >= remove_at).alias("remove"))
    return t.groupBy("text_md5").agg(F.sort_array(F.collect_list(place)).alias("terms"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``(doc_id, spans, terms)``: base spans, and places of disclosing terms (null: none)."""
    found = written(find(docs, id_col, text_col), "found")
    terms = term_spans(docs, found, text_col, **limits)
    return found.select("doc_id", "text_md5", "spans").join(terms, "text_md5", "left").select("doc_id", "spans", "terms")


def _class_of(term: str) -> str:
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def redact(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """Base spans become their kind; terms become their class or go."""
    marks = sorted([(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)]
                   + [(a, b, "" if gone else _class_of(text[a:b])) for a, b, gone in terms])
    out, at = [], 0
    for start, end, put in marks:
        if start >= at:
            out += (text[at:start], put)
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text_col``; null texts stay null."""
    found = written(find(docs, id_col, text_col), "found")
    terms = written(term_spans(docs, found, text_col, **limits), "terms")
    marks = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["start"], t["end"], t["remove"].cast("int"))), ",")
    terms = terms.select("text_md5", marks.alias("marks"))
    d, new, old = apart(docs)
    at = new[old.index(text_col)]
    d = d.withColumn("text_md5", F.md5(F.coalesce(F.col(at), F.lit("")))).join(terms, "text_md5", "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = [None if t is None else redact(t, [(int(a), int(b), c == "1") for a, b, c in
                                                  (x.split(":") for x in (m or "").split(",") if x)])
               for t, m in zip(texts, marks, strict=True)]
        return pd.Series(out, dtype="object")

    return d.withColumn(at, clean(F.col(at), F.col("marks"))).select(*new).toDF(*old)
