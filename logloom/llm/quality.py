"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a temperature.

Each word has a sparse ternary index vector (by hash) and so has its outward shape; a word's vector is
the sum of its neighbours' index vectors over the sample. A document is the mean and spread of its
words' vectors and a few sums over them. Network, vectors and temperature are fitted in numpy on the
driver from a bounded sample of labelled rows (``sample``), weighted by the labels' shares among all such
rows; the temperature, fitted on folds that a network like it has not learned from, makes scores probabilities.

Null and empty texts get the model's score of no words, very long ones are scored whole. Repeated rows and
rows without an id are scored each on its own (held_out is false without an id). With no labelled row, or
labels of one kind only, every score is the share of label 1 (1 without any row). An empty table gives an
empty result; other columns are neither read nor, unless with_quality is asked, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import gram_hashes, mix64, pieces, read, remainder, settle
from .learn import Adam, Sample, Vocabulary, labelled_sample, parts_of, sigmoid, text_column, words_of

FOLD = (4, 2)
SAMPLE = 4000
DIM = 48
SHAPES = 256
CUT = 0.7
#: Steps of training at least, however small the sample.
STEPS = 200
#: Parts of the sample that the temperature is fitted on in turn.
FOLDS = 4


def index_vectors(hashes: np.ndarray, dim: int = DIM, live: int = 6) -> np.ndarray:
    """Sparse ternary vectors, ``live`` places each, by hash alone."""
    out = np.zeros((len(hashes), dim), np.float32)
    rows = np.arange(len(hashes))
    for k in range(live):
        h = mix64(hashes + np.uint64((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        out[rows, (h % np.uint64(dim)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1).astype(np.float32)
    return out


def shapes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A small number for how each word looks: kinds of its first, second and last byte, and its length."""
    kind = np.full(256, 3, np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    last = np.full(256, 3, np.int64)
    last[97:123], last[65:91], last[128:] = 0, 0, 0
    last[[46, 44]], last[[33, 63]] = 1, 2
    second = kind[raw[np.minimum(begin + 1, end - 1)]] == 1
    size = np.searchsorted([2, 4, 12, 40], end - begin)
    return ((kind[raw[begin]] * 4 + last[raw[end - 1]]) * 2 + second) * 5 + size


def fitted_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """What logits are divided by so that their probabilities are the likeliest: by golden section over its logarithm.
    Each label is held to be wrong for one row more than it is, so that separable rows don't make scores certain."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(log_t: float) -> float:
        x = z * np.exp(-log_t)
        return float((weight * (np.logaddexp(0, x) - target * x)).sum())

    low, high, ratio = np.log(0.02), np.log(20), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class PooledNetwork:
    def __init__(self, buckets: int = 1 << 14, hidden: int = 24, seed: int = 5):
        self.buckets, self.hidden, self.seed = buckets, hidden, seed
        self.constant: float | None = None

    def fit(self, sample: Sample, epochs: int = 60, batch: int = 64) -> PooledNetwork:
        texts, y = sample.texts, sample.y
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return self
        weight = sample.weights()
        parts = parts_of(texts, 1 << 18)  # a part's word vectors take some hundred times its bytes
        self.vocabulary = self._widespread(parts)
        self.vectors = self._train_vectors(parts)
        x = np.concatenate([self.pooled(part) for part in parts])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        # the temperature comes from rows that the network of their fold has not seen, the network from all
        fold, z = np.random.default_rng(self.seed).permutation(len(y)) % FOLDS, np.zeros(len(y))
        for k in range(FOLDS):
            self._train(x[fold != k], y[fold != k], weight[fold != k], epochs, batch)
            z[fold == k] = self._forward(x[fold == k])
        self.temperature = fitted_temperature(z, y, weight)
        self._train(x, y, weight, epochs, batch)
        return self

    def _train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, batch: int) -> None:
        rng = np.random.default_rng(self.seed)
        self.p = {
            "A": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)),
            "a": np.zeros(self.hidden),
            "u": rng.normal(0, self.hidden**-0.5, self.hidden),
            "b": np.zeros(1),
        }
        opt, order = Adam(self.p, 0.004), np.arange(len(y))
        epochs = max(epochs, -(-STEPS * batch // max(1, len(y))))
        for epoch in range(epochs):
            opt.rate = 0.004 * (1 - epoch / epochs)
            rng.shuffle(order)
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                hid = np.tanh(x[rows] @ self.p["A"] + self.p["a"])
                g = weight[rows] * (sigmoid(hid @ self.p["u"] + self.p["b"][0]) - y[rows]) / len(rows)
                back = g[:, None] * self.p["u"] * (1 - hid * hid)
                opt.step({"A": x[rows].T @ back + 1e-3 * self.p["A"], "a": back.sum(0), "u": hid.T @ g + 1e-3 * self.p["u"], "b": np.array([g.sum()])})

    def _widespread(self, parts: list[pa.Array]) -> Vocabulary:
        def words() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in parts:
                _, _, h, first, _, _ = words_of(part, fold=False)
                yield h, np.repeat(np.arange(len(part)), np.diff(first))

        return Vocabulary.of(words(), self.buckets, 5)

    def _train_vectors(self, parts: list[pa.Array], reach: int = 2) -> np.ndarray:
        """Sums of the neighbours' index vectors, a part of the sample at a time; to length 1."""
        n = self.buckets + 1
        table = np.zeros((n + SHAPES, DIM), np.float32)
        look = index_vectors(np.arange(SHAPES, dtype=np.uint64) + np.uint64(991))
        for part in parts:
            raw, _, h, first, begin, end = words_of(part, fold=False)
            doc = np.repeat(np.arange(len(part)), np.diff(first))
            ids, shape = self.vocabulary.ids(h), shapes(raw, begin, end)
            own = index_vectors(h) + look[shape]
            around = np.zeros_like(own)
            for lag in range(1, reach + 1):
                same = (doc[lag:] == doc[:-lag])[:, None]
                around[lag:] += own[:-lag] * same
                around[:-lag] += own[lag:] * same
            for rows, base in ((ids, 0), (shape, n)):
                order = np.argsort(rows, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(rows[order]) > 0)) if len(rows) else order
                if len(at):
                    table[base + rows[order][at]] += np.add.reduceat(around[order], at)
        return table / (np.linalg.norm(table, axis=1, keepdims=True) + 1e-9)

    def pooled(self, texts: pa.Array) -> np.ndarray:
        raw, _, h, first, begin, end = words_of(texts, fold=False)
        n, count = len(first) - 1, np.diff(first)
        has = count > 0
        doc = np.repeat(np.arange(n), count)
        some = np.maximum(count, 1)[:, None]
        shape = shapes(raw, begin, end)

        def mean(x: np.ndarray) -> np.ndarray:
            out = np.zeros((n, x.shape[1]))
            if has.any():
                out[has] = np.add.reduceat(x, first[:-1][has])
            return out / some

        ids = self.vocabulary.ids(h)
        word = mean(self.vectors[ids])
        look = np.zeros((n, SHAPES))
        np.add.at(look, (doc, shape), 1)
        look = look / some @ self.vectors[self.buckets + 1 :]
        same = np.zeros((n, 3))
        for k in range(3):
            if len(h) > k + 1:
                eq = (h[k + 1 :] == h[: -k - 1]) & (doc[k + 1 :] == doc[: -k - 1])
                same[:, k] = np.bincount(doc[k + 1 :][eq], minlength=n)
        parts = [word, look, same / some]
        for size in (1, 3):
            g = gram_hashes(h, size)
            d = doc[: len(g)]
            ok = d == doc[size - 1 :] if len(g) else np.zeros(0, bool)
            g, d = mix64(g[ok] + d[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), d[ok]
            _, at = np.unique(g, return_index=True)
            parts.append((np.bincount(d[at], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1))[:, None])
        parts += [np.linalg.norm(word, axis=1, keepdims=True), np.log1p(count)[:, None], (np.bincount(doc[ids == self.buckets], minlength=n) / some[:, 0])[:, None]]
        return np.concatenate(parts, 1)

    def _forward(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["A"] + self.p["a"]) @ self.p["u"] + self.p["b"][0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.clip((self.pooled(texts) - self.mean) / self.scale, -8, 8)
        return sigmoid(self._forward(x) / self.temperature)


def score_quality(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; other columns are left out."""
    return with_quality(docs.select("doc_id", "text"), labels, "score", fold, sample).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(remainder("doc_id", fold[0]), F.lit(-1)) == fold[1]).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def with_quality(docs: DataFrame, labels: DataFrame, score: str, fold: tuple[int, int] = FOLD, sample: int = SAMPLE) -> DataFrame:
    """docs and a column of that name with the score."""
    model = PooledNetwork().fit(labelled_sample(docs, labels, "quality", fold, sample))
    settle(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(text_column(batch)), pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
