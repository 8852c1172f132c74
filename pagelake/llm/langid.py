"""Language identification by bit-sliced Bloom filters of n-grams.

One Bloom filter per language, stored side by side: slot ``j`` of the table is
a bit mask with one bit per language.  The masks at the ``HASHES`` slots of an
n-gram, combined by AND, give all languages that contain it at once.  Per text
and language the hits are counted; a filter with a share ``f`` of set bits
answers yes by chance for ``f ** HASHES`` of foreign n-grams, and the counts
are corrected for that before the largest one decides.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any learned language every text is; a text with letters but without
an n-gram of any language gets the first language in order, with score 0, and
so do ties; very long texts are counted whole; repeated rows get equal answers;
rows without a language are not learned from; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm import ngrams, sampling
from pagelake.llm.common import map_texts, pick

SIZES = (3, 4, 5)
HASHES = 3
SLOTS = 1 << 20
UNKNOWN = "und"
# Documents per language that the filters are filled from, at most about this many.
SAMPLE_PER_LANGUAGE = 400
MIN_COUNT = 2
# An n-gram that makes up less than this share of the n-grams of a language's sample is none of the language.
MIN_RATE = 1e-5
LANE = 64


def _slots(h: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(slots)).astype("int64") for i in range(hashes)]


@dataclass
class Filters:
    """``table[slot, lane]`` holds the bits of 64 languages per lane."""

    languages: list[str]
    table: np.ndarray
    hashes: int = HASHES

    def chance(self) -> np.ndarray:
        """Per language: how often a foreign n-gram hits by chance."""
        return np.array([(((self.table[:, i // LANE] >> np.uint64(i % LANE)) & np.uint64(1)).mean()) ** self.hashes
                         for i in range(len(self.languages))])

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as bit masks."""
        found = None
        for at in _slots(h, len(self.table), self.hashes):
            found = self.table[at] if found is None else found & self.table[at]
        return found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits per text and language, n-grams per text, and whether a text has a letter."""
        codes, ends = ngrams.letter_codes(texts)
        letters = ngrams.per_text(codes != ngrams.GAP, np.arange(len(codes)), ends) > 0
        hits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, h in ngrams.hashed(codes, SIZES):
            n += ngrams.per_text(np.ones(len(at)), at, ends)
            masks = self.masks(h)
            for i in range(len(self.languages)):
                hits[:, i] += ngrams.per_text((masks[:, i // LANE] >> np.uint64(i % LANE)) & np.uint64(1), at, ends)
        return hits, n, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        hits, n, letters = self.counts(texts)
        chance = np.minimum(self.chance(), 0.999)
        true = np.maximum(0.0, (hits - n[:, None] * chance) / (1 - chance))
        best = true.argmax(axis=1)
        total = true.sum(axis=1)
        score = np.where(letters & (total > 0), true[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.clip(score, 0, 1)


def build(texts: list[str], langs: list[str], slots: int = SLOTS, hashes: int = HASHES, min_count: int = MIN_COUNT,
          min_rate: float = MIN_RATE) -> Filters:
    """Filters with the n-grams of each language.

    An n-gram belongs to a language if it occurs ``min_count`` times in its
    texts and makes up ``min_rate`` of all their n-grams, so a stray quotation
    of another language does not count.  Other languages have no say: an n-gram
    that many share is in the filters of all of them.
    """
    names = sorted(set(langs))
    table = np.zeros((slots, max(1, -(-len(names) // LANE))), "uint64")
    for i, name in enumerate(names):
        codes, _ = ngrams.letter_codes([t for t, x in zip(texts, langs, strict=True) if x == name])
        h = np.concatenate([h for _, h in ngrams.hashed(codes, SIZES)] or [np.empty(0, "uint64")])
        distinct, n = np.unique(h, return_counts=True)
        kept = distinct[n >= max(min_count, min_rate * len(h))]
        for at in _slots(kept, slots, hashes):
            # several n-grams may meet in a slot: all set the same bit
            table[at, i // LANE] |= np.uint64(1 << (i % LANE))
    return Filters(names, table, hashes)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Build the filters from about ``per_language`` documents of each language."""
    rows = pick(docs, doc_id=id_col, lang=lang_col)
    chosen = sampling.per_label(rows, "lang", per_language)
    d = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    got = d.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()
    return build([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def run(texts: list[str]) -> dict:
        lang, score = sent.value.predict(texts)
        return {"lang_pred": lang, "score": score}

    return map_texts(d, "text", "lang_pred string, score double", run, 1_000_000)
