"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own, those of the line before and after it, and where it
stands; the two-state chain adds how likely labels follow each other. Training documents lend their label to all
their lines, and stochastic gradients of the chain's likelihood fit the weights. A document's raw quality
is the length-weighted mean of its lines' forward-backward marginals; a logistic curve fitted on training
documents turns that into a probability.

The fit reads at most `sample_docs` labelled documents (the smallest hashes of doc_id), of them whole
texts; every document is scored on its whole text.

Edge cases: null, empty and wordless texts score by the same curve at raw value 0; very long texts score by all their lines; texts of
equal marginals score alike, as do repeated rows; null labels are not learned from; with no labels at all every score
is 0.5, with one class it is that class's smoothed share; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import map_chunks, slices
from keelson.llm.features import NAMES, line_features
from keelson.llm.sampling import hashed_sample

WIDTH = 3 * len(NAMES) + 3


def with_neighbours(f: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each line's features, its neighbours' in the same text, first and last flags, bias."""
    n = len(f)
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:], last[:-1] = of[1:] != of[:-1], of[1:] != of[:-1]
    out = np.zeros((n, WIDTH), np.float32)
    k = len(NAMES)
    out[:, :k] = f
    out[1:, k : 2 * k] = f[:-1] * ~first[1:, None]
    out[:-1, 2 * k : 3 * k] = f[1:] * ~last[:-1, None]
    out[:, -3], out[:, -2], out[:, -1] = first, last, 1
    return out


def marginals(score: np.ndarray, of: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and pair marginals summed, of chains of (bad, good) states. score: log-odds of good for each line."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    emit = np.stack([np.zeros(n), score], axis=1)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")  # texts with at least t + 1 lines
    alpha[starts] = emit[starts]
    for t in range(1, lengths[0]):
        at = starts[: alive[t]] + t
        a = alpha[at - 1][:, :, None] + chain
        alpha[at] = np.logaddexp(a[:, 0], a[:, 1]) + emit[at]
    for t in range(lengths[0] - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        b = chain[None] + (emit[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    joint = alpha + beta
    z = np.logaddexp(joint[:, 0], joint[:, 1])
    inner = np.ones(n, bool)
    inner[starts] = False
    j = np.flatnonzero(inner)
    pair = np.exp(alpha[j - 1][:, :, None] + chain + (emit[j] + beta[j])[:, None, :] - z[j][:, None, None])
    return np.exp(joint[:, 1] - z), pair.sum(axis=0)


def means(p: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted means of p by text; 0 for texts without lines."""
    w = np.bincount(of, weight, n)
    return np.bincount(of, p * weight, n) / np.maximum(w, 1e-9)


class LineCrf:
    """The fitted chain and the curve from raw quality to probability."""

    def __init__(self):
        self.weights, self.chain = np.zeros(WIDTH), np.zeros((2, 2))
        self.mean, self.std = np.zeros(WIDTH), np.ones(WIDTH)
        self.curve = (0.0, 0.0)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for part in slices(texts):
            f, of, length = line_features(texts[part])
            p, _ = marginals(((with_neighbours(f, of) - self.mean) / self.std) @ self.weights, of, self.chain)
            out.append(means(p, of, length.astype(float), part.stop - part.start))
        return np.concatenate(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = self.raw(texts)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * raw + self.curve[1], -30, 30)))

    def fit(self, texts: list[str | None], labels: list[int], epochs: int = 12, batch: int = 64, seed: int = 5) -> LineCrf:
        y = np.array(labels, float)
        share = (y.sum() + 1) / (len(y) + 2)
        if not len(y) or y.min() == y.max():
            self.curve = (0.0, float(np.log(share / (1 - share))) if len(y) else 0.0)
            return self
        made = [(with_neighbours(*got[:2]), got[1] + part.start) for part in slices(texts) for got in (line_features(texts[part]),)]
        x, of = (np.concatenate([m[i] for m in made]) for i in (0, 1))
        if len(x):
            self.mean, self.std = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-6
            self.mean[-1], self.std[-1] = 0, 1
            x = (x - self.mean) / self.std
        at = np.searchsorted(of, np.arange(len(y) + 1))
        rng = np.random.default_rng(seed)
        g2, c2 = np.full(WIDTH, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(order), batch):
                docs = [d for d in order[s : s + batch] if at[d + 1] > at[d]]
                if not docs:
                    continue
                rows = np.concatenate([np.arange(at[d], at[d + 1]) for d in docs])
                n = np.concatenate([np.full(at[d + 1] - at[d], k) for k, d in enumerate(docs)])
                weight = 1 / np.sqrt(np.bincount(n))[n]  # long texts don't drown the others
                p, pairs = marginals(x[rows] @ self.weights, n, self.chain)
                g = ((y[docs][n] - p) * weight) @ x[rows] / len(docs) - 1e-3 * self.weights
                gold = np.zeros((2, 2))
                for k, d in enumerate(docs):
                    gold[int(y[d]), int(y[d])] += at[d + 1] - at[d] - 1
                c = (gold - pairs) / max(1, len(rows)) - 1e-2 * self.chain
                g2 += g * g
                c2 += c * c
                self.weights += 0.3 * g / np.sqrt(g2)
                self.chain += 0.05 * c / np.sqrt(c2)
        raw = self.raw(texts)
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton steps of a logistic curve with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            h = p * (1 - p) + 1e-9
            ga, gb = ((y - p) * raw).sum() - 0.01 * a, (y - p).sum() - 0.01 * b
            haa, hab, hbb = (h * raw * raw).sum() + 0.01, (h * raw).sum(), h.sum() + 0.01
            det = haa * hbb - hab * hab
            a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
        self.curve = (float(a), float(b))
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[list[str], list[int]]:
    """At most `sample_docs` texts and labels outside the held-out fold. docs: doc_id, text; labels: doc_id, label."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    rows = hashed_sample(rows, "doc_id", sample_docs)
    got = docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))  # at most sample_docs rows
    got = got.select("text", "label", "doc_id").orderBy("doc_id").collect()
    return [r["text"] for r in got], [r["label"] for r in got]


def score_rows(docs: DataFrame, score, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, where score maps a list of texts to probabilities."""

    def run(rows: dict[str, list]) -> dict:
        s = np.asarray(score(rows["text"]), float)
        return {"id": rows["id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

    got = map_chunks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, score double, predicted int")
    return got.select(F.col("id").alias(id_col), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def score_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000, threshold: float = 0.3) -> DataFrame:
    """labels: doc_id, label. See the module for what is fitted on what."""
    crf = LineCrf().fit(*labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, sample_docs))
    return score_rows(docs, crf.score, threshold)
