"""Quality by positive-unlabelled learning.

The class prior, the share of good documents in unlabelled text, is estimated from positives and unlabelled text alone: a
network told to tell the two apart scores parts of both it was not fitted on, and above the best threshold the share
of unlabelled texts over that of positives is the prior (best bin estimate). No negative label is ever used.

A small network on text statistics then minimises the non-negative unbiased risk: trusted positives stand for good text,
unlabelled web text for the mixture of good and bad, and the class prior says how much of it is good. The risk of
the unlabelled part less that of its positive share estimates the risk on bad text; where it would turn negative, the
step goes back instead of overfitting.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import in_sample, map_rows

TRAIN_POSITIVE = 6000  # documents at most, but for the spread of a hash
TRAIN_UNLABELLED = 12000  # likewise
HIDDEN = 24
STEPS = 3000
BATCH = 512
RATE = 0.005
DEFAULT_PRIOR = 0.5
PRIOR_STEPS = 1000
PRIOR_BOUNDS = (0.01, 0.99)
CONFIDENCE, SLACK = 0.1, 0.01  # of the best bin estimate
MARK = re.compile(r"[^\w\s.,;:'’\"()!?-]")
FEATURES = 18


def statistics(text: str | None) -> np.ndarray:
    """Shape of a whole text: sizes, classes of characters, repetition, marks, lines. Empty texts are all zero."""
    out = np.zeros(FEATURES, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(raw, minlength=256) / len(raw)
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) or 1
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = [len(w) for w in words]
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    ends = [w[-1] for w in words]
    out[:] = (
        np.log1p(n),
        np.mean(lengths) / 10,
        np.std(lengths) / 10,
        upper / (upper + lower + 1e-6),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        kinds[48:58].sum() * 10,
        kinds[[33, 63]].sum() * 10,
        kinds[[44, 46, 59, 58]].sum() * 10,
        len(MARK.findall(text)) / len(text) * 10,
        sum(not any(c.isalnum() for c in w) for w in words) / n,
        len(counts) / n,
        np.log(len(counts)) / np.log1p(n),
        top / n,
        repeated / n,
        pairs / n,
        sum(not e.isalnum() for e in ends) / n,
        np.log1p(n / len(lines)) / 5,
        len(set(lines)) / len(lines),
    )
    return out


class QualityModel:
    """Standardised statistics, one hidden layer, one logit."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, layers: list[np.ndarray]):
        self.center, self.scale, self.layers = center, scale, layers

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.center) / self.scale @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, steps: int, slopes) -> QualityModel:
    """Adam on batches of as many positives as unlabelled rows; ``slopes(scores)`` is the risk's slope by logit."""
    rng = np.random.default_rng(0)
    both = np.concatenate([positive, unlabelled])
    center, scale = both.mean(0), both.std(0) + 1e-3
    layers = [
        rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN),
        np.array(0.0),
    ]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    p_all, u_all = (positive - center) / scale, (unlabelled - center) / scale
    for step in range(1, steps + 1):
        p = p_all[rng.integers(0, len(p_all), BATCH)]
        u = u_all[rng.integers(0, len(u_all), BATCH)]
        x = np.concatenate([p, u])
        hidden = np.tanh(x @ layers[0] + layers[1])
        g = slopes(1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30))))
        back = np.outer(g, layers[2]) * (1 - hidden * hidden)
        grads = [x.T @ back, back.sum(0), hidden.T @ g, g.sum()]
        rate = RATE * (1 - step / steps)
        for i, grad in enumerate(grads):
            grad = grad + 1e-4 * layers[i]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (
                np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
            )
    return QualityModel(center, scale, layers)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> QualityModel:
    """Minimise prior·R⁺(P) + max(0, R⁻(U) − prior·R⁻(P)) with the sigmoid loss."""

    def slopes(s: np.ndarray) -> np.ndarray:
        slope = s * (1 - s)  # loss of calling a positive bad is 1 - s, of calling a negative good s
        bad = s[BATCH:].mean() - prior * s[:BATCH].mean()
        g = np.zeros(len(s))
        if bad >= 0:
            g[:BATCH] = -prior * slope[:BATCH] / BATCH - prior * slope[:BATCH] / BATCH
            g[BATCH:] = slope[BATCH:] / BATCH
        else:
            g[:BATCH] = prior * slope[:BATCH] / BATCH
            g[BATCH:] = -slope[BATCH:] / BATCH
        return g

    return _descend(positive, unlabelled, STEPS, slopes)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, by the best bin.

    A network separates one half of each from the other by the logistic loss; the other halves are scored. Above any
    threshold, the share of unlabelled rows over the share of positives is at least the prior, and comes near it where no
    bad row scores; the threshold with the lowest upper confidence bound is taken. With fewer than two rows of either
    kind it is ``DEFAULT_PRIOR``; the result stays within ``PRIOR_BOUNDS``.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return DEFAULT_PRIOR
    told = np.concatenate([np.ones(BATCH), np.zeros(BATCH)])
    model = _descend(positive[::2], unlabelled[::2], PRIOR_STEPS, lambda s: (s - told) / BATCH)
    p, u = np.sort(model.logits(positive[1::2])), np.sort(model.logits(unlabelled[1::2]))
    # Share of each part that scores at least as high as each positive.
    above_p = 1 - np.searchsorted(p, p, "left") / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    spread = np.sqrt(np.log(4 / CONFIDENCE) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((above_u + (1 + SLACK) * spread) / above_p)
    return float(np.clip(above_u[best] / above_p[best], *PRIOR_BOUNDS))


def _measured(rows: DataFrame, schema: str) -> DataFrame:
    """(first column, statistics) for rows of (key, text)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([statistics(v.as_py()) for v in batch.column(1)], np.float32)
            flat = pa.array(found.reshape(-1))
            ends = pa.array(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["k", "x"])

        return work

    return map_rows(rows, make, schema)


def train(
    learn: DataFrame,
    labels: DataFrame,
    positives: int = TRAIN_POSITIVE,
    unlabelled: int = TRAIN_UNLABELLED,
) -> QualityModel | float:
    """Fit on documents (doc_id, text) and labels (doc_id, quality), both of the learning part only.

    Samples hold about these numbers of documents, chosen by hash of the id, each id once. Labels only say which
    documents are trusted as good; the prior comes from ``estimate_prior``. Without positives or unlabelled documents there
    is nothing to learn and the result is ``DEFAULT_PRIOR``, the score of every text.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("q"))
    n_trusted = marks.where("q = 1").count()
    texts = learn.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    trusted = marks.where("q = 1").where(in_sample(F.col("doc_id"), min(1, positives / max(1, n_trusted))))
    good = texts.join(F.broadcast(trusted.select("doc_id")), "doc_id")  # about ``positives`` ids
    web = texts.where(in_sample(F.col("doc_id"), min(1, unlabelled / max(1, learn.count()))))
    web = web.join(marks.select("doc_id"), "doc_id", "left_anti")
    good, web = (d.select(F.xxhash64("doc_id").alias("k"), "text").dropDuplicates(["k"]) for d in (good, web))
    # Bounded: FEATURES numbers for each sampled row.
    p, u = (
        np.array([r.x for r in sorted(_measured(rows, "k long, x array<float>").collect(), key=lambda r: (r.k, r.x))])
        for rows in (good, web)
    )
    return fit(p, u, estimate_prior(p, u)) if len(p) and len(u) else DEFAULT_PRIOR


def score(docs: DataFrame, model: QualityModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row from its whole text; NULL and empty texts are scored like any by their statistics.

    Rows are judged one by one, repeated ones alike; other columns are not read.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(v.as_py()) for v in batch.column(1)])
            s = model.scores(x) if isinstance(model, QualityModel) else np.full(len(x), model)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"doc_id {kind}, score double")
