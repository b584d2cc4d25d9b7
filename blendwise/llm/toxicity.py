"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as two vectors: one of its own bucket and the mean of its character n-grams' buckets, so that new
spellings of known stems are seen. The network reads windows of ``WINDOW`` words that overlap by half; a document is
as toxic as its worst window. Only documents are labelled, so the fit picks, again and again, the window of
each that the network finds worst, and learns from it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import in_sample, map_rows

WINDOW = 32
STRIDE = 16
WORD_BITS, CHAR_BITS = 14, 14
EMBED = 8
HIDDEN = 12
TRAIN_DOCS = 1200  # of either label, but for the spread of a hash
TRAIN_CHARACTERS = 20_000  # longer texts do not enter the training sample
STEPS, MIN_ROUNDS, RATE, BATCH = 600, 4, 0.01, 32
WORD = re.compile(r"[^\W_]+")
CHUNK = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Buckets:
    """Buckets of words: ``own`` of each whole word, ``flat`` of its character n-grams (three and four, with borders)."""

    def __init__(self, words: list[str]):
        full = (1 << WORD_BITS) - 1
        own = (xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) & full for w in words)
        self.own = np.fromiter(own, np.int64, len(words))
        codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), "<u4")
        word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
        owners, grams = [], []
        for size in (3, 4):
            at = np.flatnonzero(word[: len(word) - size + 1] == word[size - 1 :])
            run = np.full(len(at), size, np.uint32)
            for i in range(size):
                run = (run ^ codes[at + i]) * np.uint32(0x01000193)
                run ^= run >> np.uint32(15)
            owners.append(word[at])
            grams.append((run * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CHAR_BITS))
        owners = np.concatenate(owners)
        self.flat = np.concatenate(grams)[np.argsort(owners, kind="stable")].astype(np.int64)
        self.size = np.bincount(owners, minlength=len(words))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-gram buckets of some words, one after the other, and for each its place in ``words``."""
        size = self.size[words]
        skip = self.begin[words] - np.concatenate([[0], np.cumsum(size)[:-1]])
        return self.flat[np.repeat(skip, size) + np.arange(size.sum())], np.repeat(np.arange(len(words)), size)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover all of ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    """Parameters, the pass forward and the pass back."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        width, h = 2 * EMBED, HIDDEN
        self.p = {
            "word": rng.normal(0, 0.1, (1 << WORD_BITS, EMBED)),
            "char": rng.normal(0, 0.1, (1 << CHAR_BITS, EMBED)),
            "A": rng.normal(0, (2 * h) ** -0.5, (2 * h, h)),
            "v": rng.normal(0, h**-0.5, h),
            "w": rng.normal(0, (2 * h) ** -0.5, 2 * h),
            "b": np.zeros(1),
        }
        for side in ("f", "r"):
            self.p[f"W{side}"] = rng.normal(0, width**-0.5, (width, 3 * h))
            self.p[f"U{side}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            self.p[f"c{side}"] = np.zeros(3 * h)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift, self.slope = 0.0, 1.0

    def inputs(self, buckets: Buckets, words: np.ndarray | None = None) -> np.ndarray:
        """One row per word: of all, or of those numbered."""
        words = np.arange(len(buckets.own)) if words is None else words
        if not len(words):
            return np.empty((0, 2 * EMBED), np.float32)
        flat, _ = buckets.grams(words)
        size = buckets.size[words]  # a word with its borders has one n-gram at least
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        chars = np.add.reduceat(self.p["char"][flat], starts, 0) / size[:, None]
        return np.concatenate([self.p["word"][buckets.own[words]], chars], 1).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States (T, B, H) of one direction; x is already projected to the three gates."""
        steps, batch, h = x.shape[0], x.shape[1], HIDDEN
        state, out, trail = np.zeros((batch, h), np.float32), np.empty((steps, batch, h), np.float32), []
        u = self.p[f"U{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = state @ u
            zr = sigmoid(x[t, :, : 2 * h] + gates[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + r * gates[:, 2 * h :])
            m = mask[t][:, None]
            after = state + m * (1 - z) * (new - state)
            if keep:
                trail.append((t, state, z, r, new, gates[:, 2 * h :], m))
            out[t] = state = after
        return out, trail

    def forward(self, projected: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logits (B,) of windows: gate inputs per direction (T, B, 3H) and mask (T, B)."""
        f, tf = self._run(projected["f"], mask, "f", keep)
        r, tr = self._run(projected["r"], mask, "r", keep)
        states = np.concatenate([f, r], 2)
        hidden = np.tanh(states @ self.p["A"])
        energy = np.where(mask > 0, hidden @ self.p["v"], -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logits = pooled @ self.p["w"] + self.p["b"][0]
        return (logits, (states, hidden, weight, pooled, tf, tr)) if keep else logits

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"W{s}"] + self.p[f"c{s}"] for s in ("f", "r")}

    def gradients(self, x: np.ndarray, mask: np.ndarray, error: np.ndarray, cache) -> tuple[dict, np.ndarray]:
        """Of all parameters but the embeddings, and of the inputs x (T, B, 2·EMBED); error: dLoss/dlogit."""
        states, hidden, weight, pooled, tf, tr = cache
        h, g = HIDDEN, {}
        g["w"], g["b"] = pooled.T @ error, np.array([error.sum()])
        dpool = error[:, None] * self.p["w"]
        dstates = weight[:, :, None] * dpool
        dweight = (states * dpool).sum(2)
        denergy = weight * (dweight - (weight * dweight).sum(0))
        g["v"] = np.einsum("tbh,tb->h", hidden, denergy)
        dhidden = denergy[:, :, None] * self.p["v"] * (1 - hidden * hidden)
        g["A"] = np.einsum("tbi,tbj->ij", states, dhidden)
        dstates = dstates + dhidden @ self.p["A"].T
        dx = np.zeros_like(x)
        for side, trail, part in (("f", tf, dstates[:, :, :h]), ("r", tr, dstates[:, :, h:])):
            u, w = self.p[f"U{side}"], self.p[f"W{side}"]
            du, dw, dc, carry = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * h), 0.0
            for t, before, z, r, new, inner, m in reversed(trail):
                d = part[t] + carry
                step = d * m
                dnew = step * (1 - z) * (1 - new * new)
                dz = -step * (new - before) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                dg = np.concatenate([dz, dr, dnew * r], 1)  # on the product with the state
                di = np.concatenate([dz, dr, dnew], 1)  # on the product with the input
                du += before.T @ dg
                dw += x[t].T @ di
                dc += di.sum(0)
                dx[t] += di @ w.T
                carry = d - step * (1 - z) + dg @ u.T
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = du, dw, dc
        return g, dx

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid((logits - self.shift) * self.slope)


def _spread(starts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places (T, B) of windows (first word, words), and their mask."""
    first = np.array([s for s, _ in starts])
    size = np.array([n for _, n in starts])
    step = np.arange(WINDOW)[:, None]
    mask = (step < size).astype(np.float32)
    return first + np.minimum(step, np.maximum(size - 1, 0)), mask


class Scorer:
    """Worst window of each text, with a memory of the gate inputs of words seen before."""

    KEEP = 100_000

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = {s: np.empty((0, 3 * HIDDEN), np.float32) for s in ("f", "r")}

    def numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > self.KEEP and self.known:
            self.clear()
            new = list(dict.fromkeys(words))
        if new:
            at = len(self.known)
            self.known.update((w, at + i) for i, w in enumerate(new))
            more = self.network.project(self.network.inputs(Buckets(new)))
            self.gates = {s: np.concatenate([self.gates[s], more[s]]) for s in more}
        return np.array([self.known[w] for w in words], np.int64)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text; -inf for texts without words."""
        out = np.full(len(texts), -np.inf)
        words, windows, owner = [], [], []

        def flush() -> None:
            if not windows:
                return
            places, mask = _spread(windows)
            ids = self.numbers(words)
            for at in range(0, len(windows), CHUNK):
                part = ids[places[:, at : at + CHUNK]]
                found = self.network.forward({s: self.gates[s][part] for s in ("f", "r")}, mask[:, at : at + CHUNK])
                np.maximum.at(out, owner[at : at + CHUNK], found)
            words.clear(), windows.clear(), owner.clear()

        for i, text in enumerate(texts):
            found = words_of(text)
            if not found:
                continue
            for start in window_starts(len(found)):
                windows.append((len(words) + start, min(WINDOW, len(found))))
                owner.append(i)
            words.extend(found)
            if len(windows) >= 4 * CHUNK:
                flush()
        flush()
        return out


def _evidence(docs: list[np.ndarray], labels: np.ndarray, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Shrunken log-odds of each word and n-gram bucket: how much more often toxic documents hold it."""
    out = []
    for size, pick in ((1 << WORD_BITS, lambda d: buckets.own[d]), (1 << CHAR_BITS, lambda d: buckets.grams(d)[0])):
        held = np.zeros((2, size))
        for words, label in zip(docs, labels):
            held[label, np.unique(pick(words))] += 1
        totals = np.bincount(labels, minlength=2)
        odds = np.log((held[1] + 0.5) / (totals[1] + 1)) - np.log((held[0] + 0.5) / (totals[0] + 1))
        out.append(np.clip(odds * held.sum(0) / (held.sum(0) + 5), -3, 3))
    return out[0], out[1]


def fit(texts: list[str], labels: np.ndarray) -> Network:
    """Fit on whole labelled texts; every fifth document only sets the threshold."""
    net, rng = Network(), np.random.default_rng(1)
    docs = [words_of(t) for t in texts]
    held = np.arange(len(docs)) % 5 == 4
    use = np.array([i for i in np.flatnonzero(~held) if docs[i]])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    buckets = Buckets(list(vocabulary))
    numbered = [np.array([vocabulary[w] for w in d], np.int64) for d in docs]
    word_odds, char_odds = _evidence([np.unique(numbered[i]) for i in use], labels[use], buckets)
    net.p["word"][:, 0] += word_odds
    net.p["char"][:, 0] += char_odds
    flat, windows, owner = [], [], []
    for i in use:
        for start in window_starts(len(docs[i])):
            windows.append((len(flat) + start, min(WINDOW, len(docs[i]))))
            owner.append(i)
        flat.extend(numbered[i])
    flat, owner = np.array(flat), np.array(owner)
    places, masks = _spread(windows)
    share = {1: 0.5 / max(1, labels[use].sum()), 0: 0.5 / max(1, (1 - labels[use]).sum())}
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    per_round = -(-3 * len(use) // (2 * BATCH))
    rounds, step = max(MIN_ROUNDS, -(-STEPS // per_round)), 0
    for turn in range(rounds):
        inputs = net.inputs(buckets)
        gates = net.project(inputs)
        logits = np.concatenate(
            [
                net.forward({s: gates[s][flat[places[:, a : a + CHUNK]]] for s in gates}, masks[:, a : a + CHUNK])
                for a in range(0, len(windows), CHUNK)
            ]
        )
        if turn == 0:  # before the first step the evidence itself tells which window is worst
            evidence = inputs[:, 0] + inputs[:, EMBED]
            logits = np.where(masks > 0, evidence[flat[places]], -9).max(0)
        worst = np.lexsort((-logits, owner))
        chosen = worst[np.unique(owner[worst], return_index=True)[1]]
        plain = rng.permutation(np.flatnonzero(labels[owner] == 0))[: len(chosen) // 2]
        batch_all = rng.permutation(np.concatenate([chosen, plain]))
        for at in range(0, len(batch_all), BATCH):
            part = batch_all[at : at + BATCH]
            ids, mask, y = flat[places[:, part]], masks[:, part], labels[owner[part]]
            used, local = np.unique(ids, return_inverse=True)
            small = net.inputs(buckets, used)
            x = small[local.reshape(ids.shape)]
            out, cache = net.forward(net.project(x), mask, keep=True)
            weight = np.array([share[k] for k in y]) * len(use)
            g, dx = net.gradients(x, mask, ((sigmoid(out) - y) * weight / len(part)).astype(np.float32), cache)
            dwords = np.zeros_like(small)
            np.add.at(dwords, local.reshape(-1), dx.reshape(-1, 2 * EMBED))
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], buckets.own[used], dwords[:, :EMBED])
            flat_grams, at_word = buckets.grams(used)
            np.add.at(g["char"], flat_grams, (dwords[:, EMBED:] / buckets.size[used][:, None])[at_word])
            step += 1
            for k, grad in g.items():
                grad = np.clip(grad, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                size = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                net.p[k] = (net.p[k] - RATE * (1 - turn / rounds) * size).astype(np.float32)
    _set_threshold(net, [t for t, h in zip(texts, held) if h], labels[held])
    return net


def _set_threshold(net: Network, texts: list[str], labels: np.ndarray) -> None:
    """Put probability 1/2 where the held-out documents are told apart best, in the middle of the gap."""
    logits = Scorer(net).logits(texts)
    known = np.isfinite(logits)
    logits, labels = logits[known], labels[known]
    if not len(labels) or labels.min() == labels.max():
        return
    order = np.argsort(logits)
    logits, labels = logits[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(labels)]) / labels.sum()
    wrong = wrong + (len(labels) - labels.sum() - np.concatenate([[0], np.cumsum(1 - labels)])) / (1 - labels).sum()
    best = np.flatnonzero(wrong == wrong.min())
    bounds = np.concatenate([[logits[0] - 1], logits, [logits[-1] + 1]])
    cut = best[len(best) // 2]
    net.shift = float((bounds[cut] + bounds[cut + 1]) / 2)


def train(learn: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS) -> Network | float:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic), both of the learning part only.

    The sample holds about ``per_label`` documents of either label, chosen by hash of the id, each id once, and
    texts up to ``TRAIN_CHARACTERS``. Without documents of both labels the result is the share of toxic ones.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, min(1.0, per_label / max(1, counts.get(1, 0)))).otherwise(
        min(1.0, per_label / max(1, counts.get(0, 0)))
    )
    chosen = F.broadcast(marks.where(in_sample(F.col("doc_id"), share)))  # about 2 · per_label ids
    sample = learn.where(F.length("text") <= TRAIN_CHARACTERS).join(chosen, "doc_id")
    rows = sample.groupBy(F.xxhash64("doc_id").alias("h")).agg(F.min(F.struct("text", "y")).alias("row"))
    rows = rows.select("h", "row.text", "row.y").repartition(1)  # bounded
    fitted = rows.mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else counts.get(1, 0) / max(1, sum(counts.values()))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task fits on the sample, so that the driver holds the weights alone; nothing without both labels."""
    rows = sorted(row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    y = np.array([label for _, _, label in rows], np.int64)
    if len(set(y[np.arange(len(y)) % 5 != 4])) == 2:
        network = fit([text for _, text, _ in rows], y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["model"])


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row: the probability of its worst window, over all windows of the whole text.

    NULL texts and texts without words score 0. Rows are judged one by one, repeated ones alike; other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), _scored(model), f"doc_id {kind}, score double")


def _scored(model: Network | float):
    def make():
        scorer = Scorer(model) if isinstance(model, Network) else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = []
            for at in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(at, 500).to_pylist()
                if scorer:
                    scores.append(model.probability(scorer.logits(texts)))
                else:
                    scores.append(np.array([model if words_of(t) else 0.0 for t in texts]))
            found = np.where(np.isfinite(np.concatenate(scores)), np.concatenate(scores), 0.0)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.float64))], ["doc_id", "score"])

        return work

    return make


def drop_toxic(docs: DataFrame, model: Network | float, text_col: str = "text") -> DataFrame:
    """The rows with a score below 1/2, all columns kept; rows pass through the tasks, nothing is joined."""
    at = docs.columns.index(text_col)

    def make():
        scored = _scored(model)()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], ["doc_id", "text"])
            keep = scored(pair).column(1).to_numpy() < 0.5
            return batch.filter(pa.array(keep))

        return work

    return map_rows(docs, make, docs.schema)
