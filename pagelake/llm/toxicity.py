"""Toxicity: a bag of subword vectors, averaged into a linear softmax.

Every character n-gram of a text has a vector (hashed into buckets, so unseen
spellings share the vectors of their n-grams with known ones).  The text is the
average of its vectors, and a linear layer with a softmax of two classes
decides.  Vectors and layer are trained together in numpy by mini-batch AdaGrad
on a bounded sample of labelled rows.

Because the layer is linear, a trained model reduces to one number per bucket;
scoring a text is an average of these numbers over all its n-grams.

Defined results: a text without letters (null and empty ones too) scores the
model's answer to an empty bag; repeated rows get equal scores; without labels
of both classes every score is the share of label 1, or one half; other
columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm import ngrams, sampling
from pagelake.llm.common import map_texts, pick

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
DIMENSIONS = 8
# Mini-batches that the model is trained on, whatever the sample's size.
STEPS = 1500
# A bucket needs this many sample documents to have a vector: rarer ones say nothing.
MIN_DOCUMENTS = 5
DECAY = 1e-3
# Labelled rows per class that the model is fitted on, at most about this many.
SAMPLE_PER_CLASS = 2000


def buckets(texts: list[str], count: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    codes, ends = ngrams.letter_codes(texts)
    return [(at, (h % np.uint64(count)).astype("int64")) for at, h in ngrams.hashed(codes, SIZES)], ends


def bag(text: str, count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which sum to 1."""
    found, _ = buckets([text], count)
    every = np.concatenate([b for _, b in found]) if found else np.empty(0, "int64")
    where, n = np.unique(every, return_counts=True)
    return where.astype("int32"), (n / max(1, len(every))).astype("float32")


@dataclass
class Model:
    """``weight[b]`` is the log-odds that bucket ``b`` adds, ``bias`` those of an empty bag."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        found, ends = buckets(texts, len(self.weight))
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for at, b in found:
            total += ngrams.per_text(self.weight[b], at, ends)
            n += ngrams.per_text(np.ones(len(at)), at, ends)
        return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int], prior: float, seed: int = 7, count: int = BUCKETS,
          dimensions: int = DIMENSIONS, steps: int = STEPS, rate: float = 1.0, batch: int = 16,
          min_documents: int = MIN_DOCUMENTS, decay: float = DECAY) -> Model:
    """Fit vectors and softmax together; ``prior`` is the share of label 1 among all labelled rows."""
    y = np.array(labels, "int64")
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(count), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (count, dimensions)).astype("float32")
    layer, bias = rng.normal(0, 0.1, (dimensions, 2)).astype("float32"), np.zeros(2, "float32")
    seen_v, seen_l, seen_b = np.full(count, 1e-6, "float32"), np.full(layer.shape, 1e-6, "float32"), np.full(2, 1e-6, "float32")
    bags = [bag(t, count) for t in texts]
    held = np.bincount(np.concatenate([b for b, _ in bags]), minlength=count) >= min_documents
    vectors[~held] = 0
    bags = [(b[held[b]], s[held[b]]) for b, s in bags]
    # the sample may hold more of label 1 than the table does: weigh the classes as in the table
    class_weight = (np.array([1 - prior, prior]) * len(y) / np.bincount(y, minlength=2)).astype("float32")
    for _ in range(-(-steps * batch // len(y))):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), batch):
            chosen = order[begin:begin + batch]
            where = np.concatenate([bags[i][0] for i in chosen])
            share = np.concatenate([bags[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            mean = np.zeros((len(chosen), dimensions), "float32")
            taken = vectors[where] * share[:, None]
            edges = np.searchsorted(row, np.arange(len(chosen)))
            full = np.bincount(row, minlength=len(chosen)) > 0
            if full.any():
                mean[full] = np.add.reduceat(taken, edges[full], axis=0)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            wrong = p
            wrong[np.arange(len(chosen)), y[chosen]] -= 1
            wrong *= (class_weight[y[chosen]] / len(chosen))[:, None]
            to_layer, to_bias, to_mean = mean.T @ wrong, wrong.sum(axis=0), wrong @ layer.T
            step = to_mean[row] * share[:, None] + decay * share[:, None] * vectors[where]
            # one AdaGrad scale per bucket; a bucket met twice in a batch takes both steps
            seen_v += np.bincount(where, weights=(step * step).mean(axis=1), minlength=count).astype("float32")
            np.subtract.at(vectors, where, rate * step / np.sqrt(seen_v[where])[:, None])
            seen_l += to_layer * to_layer
            seen_b += to_bias * to_bias
            layer -= rate * to_layer / np.sqrt(seen_l)
            bias -= rate * to_bias / np.sqrt(seen_b)
    odds = vectors.astype("float64") @ (layer[:, 1] - layer[:, 0]).astype("float64")
    return Model(odds, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Train on about ``per_class`` rows of each class of ``labels`` (id and label columns)."""
    rows = pick(labels, doc_id=id_col, label=label)
    chosen = sampling.per_label(rows, "label", per_class)
    d = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    # the sample is bounded by per_class, so its ids may go to every task
    got = d.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()
    return train([r["text"] for r in got], [int(r["label"]) for r in got], sampling.prior(rows, "label"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return map_texts(d, "text", "score double", lambda texts: {"score": sent.value.scores(texts)}, 1_000_000)
