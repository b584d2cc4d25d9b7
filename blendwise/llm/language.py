"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all documents of the learning part; the model is fitted on at most
``TRAIN_PER_LANGUAGE`` documents of each language with follow-the-regularised-leader and an elastic net, then its
probabilities are calibrated by one temperature on a part of that sample that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import in_sample, map_rows

BITS = 15
ORDERS = (1, 2, 3)
TRAIN_PER_LANGUAGE = 400  # documents at most, but for the spread of a hash
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether any character is a letter; fractions and superscripts are none."""
    return any(map(str.isalpha, text))


def gram_buckets(text: str, bits: int = BITS) -> np.ndarray:
    """Buckets of all character n-grams of the lower-cased text, with repetitions."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found, run = [], np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        run = (run[: len(codes) - order + 1] * np.uint32(0x01000193)) ^ codes[order - 1 :]
        if order in ORDERS:
            mixed = (run ^ np.uint32(order * 0x9E37)) * np.uint32(0x85EBCA6B)
            found.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero places and values of the TF-IDF vector of length one."""
    counts = np.bincount(gram_buckets(text), minlength=len(idf))
    at = np.flatnonzero(counts)
    values = (counts[at] * idf[at]).astype(np.float32)
    norm = float(np.sqrt(values @ values))
    return at, values / norm if norm else values


def inverse_frequencies(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """Smoothed IDF per bucket over all rows; tasks send at most one count per bucket."""
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, rows = np.zeros(width + 1, np.int64), np.zeros(width, bool), 0
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                rows += 1
                if text:
                    at = gram_buckets(text, bits)
                    seen[at] = True
                    found[:width] += seen
                    seen[at] = False
        found[width] = rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "docs"])

    sums = texts.mapInArrow(count, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    frequency = np.zeros(width + 1)
    for row in sums.collect():
        frequency[row.bucket] = row.docs
    return np.log((1 + frequency[width]) / (1 + frequency[:width])) + 1


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, width: int) -> np.ndarray:
    """Weights (width + 1, classes), the last row for the bias; one pass per epoch in a fixed random order."""
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        rate = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(z[at]) <= L1, 0, (np.sign(z[at]) * L1 - z[at]) / rate)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], width), np.append(rows[i][1], 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[labels[i]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(width + 1)).astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, among 200 from 1/20 to 20."""
    if not len(logits):
        return 1.0
    grid = np.geomspace(0.05, 20, 200)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.idf, self.temperature = languages, weights, idf, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = vector(text, self.idf)
        p = softmax((x @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def train(learn: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Fit on (doc_id, text, lang); rows without lang or letters only count in the document frequencies."""
    idf = inverse_frequencies(learn.select("text"))
    known = learn.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return LanguageModel([], np.zeros((1, 0)), idf, 1.0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    sample = known.where(in_sample(F.col("doc_id"), share[F.col("lang")]))
    sample = sample.select("lang", "text", F.xxhash64("doc_id").alias("h")).dropDuplicates(["h"])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [vector(v.as_py(), idf) for v in batch.column(1)]
            keep = [has_letter(v.as_py()) for v in batch.column(1)]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([f[0].astype("<i4").tobytes() if k else b"" for f, k in zip(found, keep)], pa.binary()),
                    pa.array([f[1].tobytes() if k else b"" for f, k in zip(found, keep)], pa.binary()),
                ],
                ["lang", "h", "at", "x"],
            )

        return work

    # At most per_language rows of each language, as sparse vectors of at most 2^BITS places.
    rows = map_rows(sample.select("lang", "text", "h"), make, "lang string, h long, at binary, x binary").collect()
    rows = sorted((r for r in rows if len(r["at"])), key=lambda r: (r.h, r.lang, bytes(r["x"])))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), idf, 1.0)
    labels = np.array([languages.index(r.lang) for r in rows])
    vectors = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["x"], np.float32)) for r in rows]
    held = np.arange(len(rows)) % 5 == 4
    fitted = np.flatnonzero(~held)
    weights = fit_ftrl([vectors[i] for i in fitted], labels[fitted], len(languages), len(idf))
    check = np.array([vectors[i][1] @ weights[vectors[i][0]] + weights[-1] for i in np.flatnonzero(held)])
    return LanguageModel(languages, weights, idf, fit_temperature(check, labels[held]))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row from its whole text.

    ``und`` with score 0 for NULL texts and texts without letters, or if nothing was learned. Rows are judged one
    by one, repeated ones alike; other columns are not read.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(v.as_py()) for v in batch.column(1)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"doc_id {kind}, lang_pred string, score double")
