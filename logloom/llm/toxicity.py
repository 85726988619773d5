"""Convolutional toxicity classifier: hashed word embeddings, filters of several widths, max pooling.

A word is known by itself and by its first four and six bytes, each hashed, so inflected and unseen forms
of a word share most of what is learned. Its embedding is the sum of the three learned ones, beside three
fixed numbers: how much more often each of them stands in texts of label 1 (counted, for a text that is
learned from, in the other half of the texts). Filters slide over the words; each is pooled by its maximum
over the text and by the mean of its maxima over the text's quarters, which tells one hit from several.
Trained in numpy on the driver from a bounded sample of labelled rows (``sample``); every text is scored
whole. Cut-offs are calibrated by the language that the text itself shows, and the scores shifted so that
each cut-off is at 0.7.

Null and empty texts get the model's score of no words, very long ones are scored whole. Repeated rows and
rows without an id are scored each on its own (held_out is false without an id). With no labelled row, or
labels of one kind only, every score is the share of label 1 (0 without any row). An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, mix64, pieces, read, remainder, settle
from .learn import FUNCTION_WORDS, Adam, Sample, Vocabulary, labelled_sample, language_of, logit, parts_of, sigmoid, text_column, words_of

FOLD = (3, 1)
SAMPLE = 5000
#: Steps of training at least, however small the sample.
STEPS = 400
WIDTHS = (1, 2, 3)
CUT = 0.7
#: What a word is known by: itself and two of its beginnings.
KEYS = 3
QUARTERS = 4
#: Held-out rows of each label from which on a language has a cut-off of its own.
LEAST_POSITIVE = 20


def keys_of(raw: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings (lower case, short words ending in zeros)."""
    out = [hashes]
    for k in (4, 6):
        h = np.full(len(begin), k, np.uint64)
        for j in range(k):
            at = begin + j
            h = h * np.uint64(257) + np.where(at < end, _FOLD[raw[np.minimum(at, len(raw) - 1)]], 0).astype(np.uint64)
        out.append(mix64(h))
    return out


class Convolution:
    def __init__(self, buckets: int = 1 << 17, dim: int = 8, filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets, self.dim, self.filters = buckets, dim, filters
        self.vocabulary = Vocabulary(np.zeros(buckets, np.uint32))
        self.odds = np.zeros(buckets + 1, np.float32)
        self.p = {"E": rng.normal(0, 0.05, (buckets + 1, dim)).astype(np.float32), "u": rng.normal(0, 0.3, 2 * filters * len(WIDTHS)), "b": np.zeros(1)}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.3, (w, dim + KEYS, filters))
            self.p[f"c{w}"] = np.zeros(filters)
        self.shift = np.zeros(len(FUNCTION_WORDS) + 1)
        self.constant: float | None = None

    def fit(self, sample: Sample, epochs: int = 8, batch: int = 64, seed: int = 7) -> Convolution:
        texts, y = sample.texts, sample.y
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        parts = parts_of(texts)

        def words() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in parts:
                raw, _, h, first, begin, end = words_of(part)
                doc = np.repeat(np.arange(len(part)), np.diff(first))
                for keys in keys_of(raw, h, begin, end):
                    yield keys, doc

        self.vocabulary = Vocabulary.of(words(), self.buckets, 5)
        docs, lang = [], []
        for part in parts:
            raw, _, h, first, begin, end = words_of(part)
            ids = np.stack([self.vocabulary.ids(k) for k in keys_of(raw, h, begin, end)], 1).astype(np.int32)
            docs += [ids[first[k] : first[k + 1]].copy() for k in range(len(part))]
            lang.append(language_of(h, first))
        lang = np.concatenate(lang)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 4], order[len(y) // 4 :]
        half = np.zeros(len(y), np.int64)
        half[train[::2]] = 1
        odds = [self._odds(docs, y, train[half[train] != k]) for k in (0, 1)]
        opt = Adam(self.p, 0.01)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        epochs = max(epochs, -(-STEPS * batch // max(1, len(train))))
        train = train.copy()
        for epoch in range(epochs):
            opt.rate = 0.01 * (1 - epoch / epochs)
            rng.shuffle(train)
            for k in range(0, len(train), batch):
                rows = train[k : k + batch]
                self._step(opt, [docs[i] for i in rows], [odds[half[i]][docs[i]] for i in rows], y[rows], weight[rows])
        self.odds = self._odds(docs, y, train)
        z = np.array([self.logits(docs[i], np.array([0, len(docs[i])]))[0] for i in held])
        counts = sample.weights()[held]
        for k in range(len(self.shift)):
            own = lang[held] == k
            own = own if y[held][own].sum() >= LEAST_POSITIVE and (1 - y[held][own]).sum() >= LEAST_POSITIVE else np.ones(len(held), bool)
            self.shift[k] = best_cut(z[own], y[held][own], counts[own])
        return self

    def _odds(self, docs: list[np.ndarray], y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each key how many standard deviations its log odds of label 1 are from those of all texts, in thirds."""
        seen = np.zeros((2, self.buckets + 1))
        for i in rows:
            seen[int(y[i]), np.unique(docs[i])] += 1
        total = np.array([(y[rows] == k).sum() for k in (0, 1)]) + 1.0
        neg, pos = seen + 0.5 * total[:, None] / total.sum()
        z = (np.log(pos / neg) - np.log(total[1] / total[0])) / np.sqrt(1 / pos + 1 / neg)
        z[self.buckets] = 0
        return np.clip(z / 3, -2, 2).astype(np.float32)

    def _step(self, opt: Adam, docs: list[np.ndarray], odds: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        p, taps, pooled = self.p, [], []
        x = [np.concatenate([p["E"][ids].sum(1), o], 1) for ids, o in zip(docs, odds)]
        for w in WIDTHS:
            best = np.zeros((len(docs), QUARTERS, self.filters))
            at = np.zeros((len(docs), QUARTERS, self.filters), np.int64)
            for d, own in enumerate(x):
                n = len(own) - w + 1
                if n > 0:
                    z = sum(own[j : n + j] @ p[f"W{w}"][j] for j in range(w)) + p[f"c{w}"]
                    for q, (a, b) in enumerate(quarters(n)):
                        at[d, q] = a + z[a:b].argmax(0)
                        best[d, q] = z[at[d, q], np.arange(self.filters)]
            best = np.maximum(best, 0)
            pooled += [best.max(1), best.mean(1)]
            taps.append((w, at, best))
        features = np.concatenate(pooled, 1)
        g = weight * (sigmoid(features @ p["u"] + p["b"][0]) - y) / len(y)
        grads: dict = {"u": features.T @ g + 1e-4 * p["u"], "b": np.array([g.sum()])}
        rows, values = [], []
        u = p["u"].reshape(len(WIDTHS), 2, self.filters)
        for k, (w, at, best) in enumerate(taps):
            top = np.arange(QUARTERS)[None, :, None] == best.argmax(1)[:, None, :]
            up = g[:, None, None] * (u[k, 0] * top + u[k, 1] / QUARTERS) * (best > 0)
            dw, (d_, q_, f_) = np.zeros_like(p[f"W{w}"]), np.nonzero(up)
            scale = up[d_, q_, f_][:, None]
            for j in range(w):
                places = at[d_, q_, f_] + j
                own = np.array([x[d][i] for d, i in zip(d_, places)]).reshape(len(d_), -1)
                np.add.at(dw[j].T, f_, scale * own)
                ids = np.array([docs[d][i] for d, i in zip(d_, places)], np.int64).reshape(len(d_), -1)
                rows.append(ids.ravel())
                values.append(np.repeat(scale * p[f"W{w}"][j].T[f_][:, : self.dim], ids.shape[1], 0))
            grads[f"W{w}"], grads[f"c{w}"] = dw + 1e-4 * p[f"W{w}"], up.sum((0, 1))
        ids = np.concatenate(rows)
        own, back = np.unique(ids, return_inverse=True)
        ge = np.zeros((len(own), self.dim))
        np.add.at(ge, back, np.concatenate(values))
        grads["E"] = (own, ge)
        opt.step(grads)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """ids: the keys of all words of some texts; first: each text's first word, and the end."""
        n = len(first) - 1
        x = np.concatenate([sum(self.p["E"][ids[:, k]] for k in range(KEYS)), self.odds[ids]], 1)
        out = np.full(n, self.p["b"][0])
        u = self.p["u"].reshape(len(WIDTHS), 2, self.filters)
        for k, w in enumerate(WIDTHS):
            pooled = np.zeros((n, QUARTERS, self.filters), np.float32)
            m = len(x) - w + 1
            has = np.flatnonzero(np.diff(first) >= w)
            if len(has):
                z = sum(x[j : m + j] @ self.p[f"W{w}"][j].astype(np.float32) for j in range(w)) + self.p[f"c{w}"].astype(np.float32)
                size = np.diff(first)[has] - w + 1
                cuts = first[has][:, None] + size[:, None] * np.arange(QUARTERS + 1) // QUARTERS
                cuts[:, :-1] = np.minimum(cuts[:, :-1], cuts[:, -1:] - 1)  # of few words some quarters share one
                edges = np.stack([cuts[:, :-1], np.maximum(cuts[:, 1:], cuts[:, :-1] + 1)], 2).reshape(-1)
                z = np.concatenate([z, z[-1:]])  # an edge may be the end
                pooled[has] = np.maximum.reduceat(z, edges)[::2].reshape(len(has), QUARTERS, -1)
            pooled = np.maximum(pooled, 0)
            out += pooled.max(1) @ u[k, 0] + pooled.mean(1) @ u[k, 1]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw, _, h, first, begin, end = words_of(texts)
        ids = np.stack([self.vocabulary.ids(k) for k in keys_of(raw, h, begin, end)], 1)
        return sigmoid(self.logits(ids, first) - self.shift[language_of(h, first)] + logit(CUT))


def quarters(n: int) -> list[tuple[int, int]]:
    """The quarters of n places; of fewer than four some share one."""
    out = []
    for q in range(QUARTERS):
        a = min(n * q // QUARTERS, n - 1)
        out.append((a, max(n * (q + 1) // QUARTERS, a + 1)))
    return out


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit above which label 1 is told with the best F1, halfway between its neighbours."""
    order = np.argsort(-z, kind="stable")
    z, hits, told = z[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (told + (weight * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # ties stay together
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = Convolution().fit(labelled_sample(docs, labels, "toxic", fold, sample))
    settle(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(model.scores(text_column(batch)), pa.float64())], ["doc_id", "score"]
                )

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, score double")
        .select(
            "doc_id",
            (F.coalesce(remainder("doc_id", fold[0]), F.lit(-1)) == fold[1]).alias("held_out"),
            "score",
            (F.col("score") >= CUT).cast("int").alias("predicted"),
        )
    )


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
