"""What the text classifiers share: bounded labelled samples, a hashed vocabulary, Adam and calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_utf8, hash_words, mix64, pieces, remainder


#: Bytes of a text that a classifier may learn from at most: bounds a sample's bytes as its rows are bounded. Longer
#: texts are scored whole like all others, but not learned from.
LONGEST = 1 << 20


@dataclass
class Sample:
    """Labelled texts, and the share of label 1 among all labelled rows that they were taken from."""

    texts: pa.Array
    y: np.ndarray
    share: float

    def weights(self) -> np.ndarray:
        """What each row counts for, so that the labels weigh as they do among all rows; 1 on average."""
        own = self.y.mean() if len(self.y) else 0.5
        return np.where(self.y == 1, self.share / max(own, 1e-9), (1 - self.share) / max(1 - own, 1e-9))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], bound: int) -> Sample:
    """At most ``bound`` labelled rows outside the fold (modulus, remainder held out), of LONGEST bytes at most, up
    to half of the bound for each label, chosen by a hash of doc_id. Rows without id or label are left out; of
    labels that differ for one id the largest counts, of texts the least."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(remainder("doc_id", fold[0]) != fold[1])
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit(17)).alias("o")
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(bound // 2) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most ``bound`` rows of two numbers
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .where(F.octet_length("text") <= LONGEST)
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .sort_by([("doc_id", "ascending")])
    )
    total = sum(counts.values())
    return Sample(rows.column("text").combine_chunks(), rows.column("y").to_numpy().astype(np.float64), counts.get(1, 0) / total if total else 0.5)


@dataclass
class Vocabulary:
    """Words hashed into buckets. A bucket's tag is that of the word that claimed it; every other word is
    unknown (the last id), so rare words never pass for known ones."""

    tags: np.ndarray

    @property
    def size(self) -> int:
        return len(self.tags)

    @classmethod
    def of(cls, parts: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int, least: int) -> Vocabulary:
        """From parts of a sample (hashes, text of each): words in ``least`` texts or more, the most widespread first."""
        words, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for h, doc in parts:
            pair = np.unique(mix64(h) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
            more, count = np.unique(h[pair], return_counts=True)
            words, back = np.unique(np.concatenate([words, more]), return_inverse=True)
            texts = np.bincount(back, np.concatenate([texts, count]), len(words)).astype(np.int64)
        order = np.lexsort((words, texts))
        order = order[texts[order] >= least]
        tags = np.zeros(buckets, np.uint32)
        words = words[order]
        tags[(words % np.uint64(buckets)).astype(np.int64)] = cls.tag(words)  # the last, most widespread, stays
        return cls(tags)

    @staticmethod
    def tag(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes % np.uint64(self.size)).astype(np.int64)
        return np.where(self.tags[at] == self.tag(hashes), at, self.size)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]) -> None:
        """A gradient is an array, or (rows, gradient of these rows) for a table of which few rows changed."""
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.params[k][at] -= (self.rate * fix * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def words_of(texts: pa.Array, fold: bool = True):
    raw, at = flat_utf8(texts)
    return (raw, at, *hash_words(raw, at, fold))


def parts_of(texts: pa.Array, most: int = 1 << 20) -> list[pa.Array]:
    """The texts in parts of about ``most`` bytes."""
    return [part.column(0) for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text", most)]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(name), "")


#: A few function words of each language, for telling languages apart by the text alone.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with was by this are".split(),
    "de": "der die und das den mit sich von ist nicht ein zu auf für".split(),
    "fr": "le la les et des est une du dans que pour qui au par".split(),
    "es": "el los las y del que en una por con para se no su".split(),
}


def language_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the index of the language with most function words; len(FUNCTION_WORDS): none of them."""
    n, langs = len(first) - 1, list(FUNCTION_WORDS.values())
    counts = np.zeros((n, len(langs) + 1))
    counts[:, -1] = 0.5
    doc = np.repeat(np.arange(n), np.diff(first))
    for k, words in enumerate(langs):
        own = words_of(pa.array(words))[2]
        counts[:, k] = np.bincount(doc[np.isin(hashes, own)], minlength=n)
    return counts.argmax(1)
