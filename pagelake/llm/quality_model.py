"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Spark tasks; the trees are fitted in
numpy on a bounded sample of labelled rows (statistics only, no texts).  The
fitted trees are flattened into parallel arrays of feature, threshold, children
and value, and all documents of a batch walk all trees together.

Defined results: null and empty texts have all statistics 0 and a score of
their own; repeated rows get equal scores; without labels of both classes every
score is the share of label 1, or one half; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm import sampling
from pagelake.llm.common import map_texts, pick, process_cache

STATISTICS = ("chars", "words", "lines", "mean_word", "long_words", "letters", "upper", "digits", "spaces", "symbols", "marks",
              "other", "distinct_words", "distinct_letters", "duplicate_lines", "mean_line", "repeated_pairs", "most_common_word",
              "upper_words", "words_without_letters", "words_with_symbols", "closed_lines", "longest_word", "word_entropy")
SYMBOLS = "#*$%&|<>~^_=+\\{}[]@"
MARKS = ".,;:!?'\"()-"
# Labelled rows per class that the trees are fitted on, at most about this many.
SAMPLE_PER_CLASS = 10_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
MIN_CHILD = 5.0
RIDGE = 1.0


def kind_table() -> np.ndarray:
    """Class of every code point: letter, upper-case letter, digit, space, symbol, mark or other."""
    table = np.full(0x110000, 6, "uint8")
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            table[i] = 2
        elif c.isspace():
            table[i] = 3
    table[[ord(c) for c in SYMBOLS]] = 4
    table[[ord(c) for c in MARKS]] = 5
    return table


def statistics(text: str) -> list[float]:
    """The values of ``STATISTICS`` for one whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(process_cache("kinds", kind_table)[codes], minlength=7) / len(codes)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), "int64", len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    counts = np.fromiter(seen.values(), "float64", len(seen)) / n
    pairs = len(set(zip(words, words[1:], strict=False)))
    symbols = set(SYMBOLS)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        float(sizes.mean()) if len(words) else 0.0, float((sizes > 12).mean()) if len(words) else 0.0,
        kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6],
        len(seen) / n, min(200.0, float(len(np.unique(codes)))), 1 - len(set(lines)) / m, np.log1p(len(text) / m),
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, float(counts.max()) if len(words) else 0.0,
        sum(c for w, c in seen.items() if w.isupper()) / n,
        sum(c for w, c in seen.items() if not any(map(str.isalpha, w))) / n,
        sum(c for w, c in seen.items() if not symbols.isdisjoint(w)) / n,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / m,
        min(1000.0, float(sizes.max())) if len(words) else 0.0, float(-(counts * np.log(counts)).sum()) if len(words) else 0.0,
    ]


@dataclass
class Trees:
    """All trees in flat arrays: inner nodes point to their children, a leaf to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(go, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, prior: float, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
              bins: int = BINS) -> Trees:
    """Boost on the logistic loss; the classes weigh as ``prior`` says."""
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    base = float(np.log(prior / (1 - prior)))
    n_of = np.bincount(y, minlength=2) if len(y) else np.zeros(2, "int64")
    if n_of.min() == 0:
        empty = np.empty(0, "int64")
        return Trees(empty, empty, np.empty(0), empty, empty, np.empty(0), base, 0)
    weight = (np.array([1 - prior, prior]) * len(y) / n_of)[y]
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    cells = binned + np.arange(width) * bins
    margin = np.full(len(y), base)

    def leaf(value: float) -> int:
        at = len(flat["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            flat[k].append(v)
        return at

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = leaf(float(-rate * g / (h + RIDGE)))
        if level == depth or h < 2 * MIN_CHILD:
            margin[rows] += flat["value"][own]
            return own
        c = cells[rows].ravel()
        gl = np.bincount(c, np.repeat(grad[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
        hl = np.bincount(c, np.repeat(hess[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
        gain = gl ** 2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g ** 2 / (h + RIDGE)
        gain[(hl < MIN_CHILD) | (h - hl < MIN_CHILD)] = -1
        f, b = divmod(int(gain.argmax()), bins)
        if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
            margin[rows] += flat["value"][own]
            return own
        low = binned[rows, f] <= b
        flat["feature"][own], flat["threshold"][own], flat["value"][own] = f, float(cuts[f][b]), 0.0
        flat["left"][own] = grow(rows[low], grad, hess, level + 1)
        flat["right"][own] = grow(rows[~low], grad, hess, level + 1)
        return own

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), 0))
    arrays = {k: np.array(v, "float64" if k in ("threshold", "value") else "int64") for k, v in flat.items()}
    return Trees(np.array(roots, "int64"), base=base, depth=depth, **arrays)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, stats)`` with the statistics of every whole text."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return map_texts(d, "text", "stats array<double>", lambda texts: {"stats": [statistics(t) for t in texts]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = SAMPLE_PER_CLASS) -> Trees:
    """Fit on about ``per_class`` rows of each class of ``labels`` (id and label columns)."""
    rows = pick(labels, doc_id=id_col, label=label)
    chosen = sampling.per_label(rows, "label", per_class)
    d = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    # the sample is bounded by per_class, so its ids may go to every task
    sample = d.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    got = measured(sample).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "stats").collect()
    x = np.array([r["stats"] for r in got], "float64").reshape(-1, len(STATISTICS))
    return fit_trees(x, np.array([int(r["label"]) for r in got], "int64"), sampling.prior(rows, "label"))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return map_texts(d, "text", "score double", lambda texts: {
        "score": sent.value.scores(np.array([statistics(t) for t in texts], "float64"))})
