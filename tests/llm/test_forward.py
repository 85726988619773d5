"""The networks' vectorised scores against plain loops, calibration, and recall by language."""

import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import decontaminate, learn, lm, quality, toxicity

from .test_models import prose, scored  # noqa: F401
from .test_text_operators import grams

DATA = "/root/testdata/sf0.1"


def sample(n=300):
    rng = random.Random(2)
    texts = [" ".join(prose(rng, rng.randrange(0, 70)) + ["vilest"] * (k % 3 == 0)) for k in range(n)]
    return learn.Sample(pa.array(texts), np.array([float(k % 3 == 0) for k in range(n)]), 0.3)


def test_toxicity_by_loops():
    model = toxicity.Convolution().fit(sample())
    texts = ["", "one", "two words", "vilest of them all", " ".join(prose(random.Random(7), 90)) + " vilest"]
    for text, got in zip(texts, model.scores(pa.array(texts))):
        raw, _, h, first, begin, end = learn.words_of(pa.array([text]))
        ids = [[int(model.vocabulary.ids(k[j : j + 1])[0]) for k in toxicity.keys_of(raw, h, begin, end)] for j in range(len(h))]
        x = [np.append(sum(model.p["E"][i] for i in row), [model.odds[i] for i in row]) for row in ids]
        z, u = model.p["b"][0], model.p["u"].reshape(len(toxicity.WIDTHS), 2, -1)
        for k, w in enumerate(toxicity.WIDTHS):
            n = len(x) - w + 1
            for f in range(model.filters):
                at = [sum(x[i + j] @ model.p[f"W{w}"][j][:, f] for j in range(w)) + model.p[f"c{w}"][f] for i in range(max(n, 0))]
                parts = [max(0.0, max(at[a:b])) for a, b in toxicity.quarters(n)] if n > 0 else [0.0] * toxicity.QUARTERS
                z += max(parts) * u[k, 0, f] + sum(parts) / len(parts) * u[k, 1, f]
        lang = learn.language_of(h, first)[0]
        assert abs(got - 1 / (1 + math.exp(-(z - model.shift[lang] + learn.logit(toxicity.CUT))))) < 1e-4


def test_quality_by_loops():
    model = quality.PooledNetwork().fit(sample())
    texts = pa.array(["", "one", "vilest of them all", " ".join(prose(random.Random(7), 50))])
    x = model.pooled(texts)
    for k, got in enumerate(model.scores(texts)):
        row = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x[k], model.mean, model.scale)]
        hidden = [math.tanh(sum(v * model.p["A"][i][j] for i, v in enumerate(row)) + model.p["a"][j]) for j in range(model.hidden)]
        z = (sum(h * u for h, u in zip(hidden, model.p["u"])) + model.p["b"][0]) / model.temperature
        assert abs(got - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9
    words = "vilest of them all".split()
    _, _, h, *_ = learn.words_of(pa.array([" ".join(words)]), fold=False)
    assert np.allclose(x[2][: quality.DIM], np.mean([model.vectors[i] for i in model.vocabulary.ids(h)], axis=0), atol=1e-6)


def test_temperature_is_the_likeliest():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z / 2.5))).astype(float)
    assert abs(quality.fitted_temperature(z, y, np.ones(len(z))) - 2.5) < 0.1
    assert abs(quality.fitted_temperature(z / 10, y, np.ones(len(z))) - 0.25) < 0.01


def test_attention_by_loops(scored, monkeypatch):  # noqa: F811
    kept, fit = {}, lm.Attention.fit
    monkeypatch.setattr(lm.Attention, "fit", lambda self, docs, **k: kept.setdefault("model", fit(self, docs, **k)))
    lm.score_texts(scored[1])
    model = kept["model"]
    by, p = model.tables(), model.p
    ids = lm.ids_of(["the lomba tarki the selran vindo " * 9], lm.tokenizer_files())[0]
    before, after, first, _ = lm._blocks([ids], model.t.unit)
    got = model.forward(before, after, first[:-1], by)["f"][after >= 0]
    read = [lm.END, *model.t.unit[ids]]
    follow = [*model.t.unit[ids], lm.END]
    w = np.exp(p["W"])
    w /= w.sum(0)
    for i, own in enumerate(read):
        start = max(0, (i // lm.BLOCK - 1) * lm.BLOCK)
        q = p["E"][own] @ p["Q"] / math.sqrt(lm.KEY)
        s = np.array([math.exp(q @ (p["E"][read[j]] @ p["K"]) + p["bias"][i - j]) for j in range(start, i + 1)])
        o = sum(a * (p["E"][read[j]] @ p["V"]) for a, j in zip(s / s.sum(), range(start, i + 1)))
        z = np.exp(p["E"][own] @ p["X"] + p["c"] + o @ p["O"])
        assert abs(got[i] - (z / z.sum()) @ w[follow[i]]) < 1e-5


def test_gradients():
    """Of the layer's loss, against differences."""
    rng = np.random.default_rng(0)
    opens = rng.random(lm.UNITS) < 0.5
    opens[lm.END] = True
    follow = np.where(opens, 1 / opens.sum(), 0)
    tables = lm.Tables(None, None, None, None, opens, follow, None, None)
    model = lm.Attention(tables)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.p["W"] += rng.normal(0, 0.3, model.p["W"].shape)
    docs = [rng.integers(0, lm.UNITS - 1, n) for n in (20, 5, 40)]
    before, after, first, _ = lm._blocks(docs, np.arange(lm.UNITS))
    caught = {}

    class Spy:
        def step(self, grads):
            caught.update(grads)

    model.step(Spy(), before, after, first[:-1])
    for name in ("Q", "K", "V", "X", "O", "c", "bias", "W", "E"):
        flat, g = model.p[name].reshape(-1), np.asarray(caught[name], np.float64).reshape(-1)
        k = int(np.abs(g).argmax())
        old, loss = flat[k], []
        for d in (1e-3, -1e-3):
            flat[k] = old + d
            loss.append(model.step(Spy2(), before, after, first[:-1]))
        flat[k] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k]) < 2e-2 * abs(g[k]) + 1e-4, name


class Spy2:
    def step(self, grads):
        pass


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_toxicity_in_every_language(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in rows if r["lang"] == lang]
        found = [r for r in own if r["toxic"] and r["predicted"]]
        assert len(found) >= 0.9 * sum(r["toxic"] for r in own) and len(found) >= 0.9 * sum(r["predicted"] for r in own), lang


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_quality_is_calibrated(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    p, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert ((p >= quality.CUT) == y).mean() > 0.99
    assert abs(p.mean() - y.mean()) < 0.01  # reliability, overall and by tenths
    tenth = np.minimum((p * 10).astype(int), 9)
    assert sum(abs(p[tenth == k].sum() - y[tenth == k].sum()) for k in range(10)) / len(p) < 0.02


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_leaks_against_all_windows(spark):
    """Every window of every text of a table, whatever its fingerprint."""
    d = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], grams(r["text"].lower().split()), len(r["text"].split())) for r in bench.collect() if r["text"]]
    want = set()
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        every = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for item, own, n in items:
            if not any(g in own for g in every):
                continue
            for s in range(max(1, len(w) - n + 1)):
                a = grams(w[s : s + n])
                both = sum((a & own).values())
                if both and 100 * both >= 75 * (sum(a.values()) + sum(own.values()) - both):
                    want.add((r["doc_id"], item))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and want


def test_unusual_rows(spark, empty):
    from logloom.llm import html, packing, rules, warc

    long = " ".join(f"w{k % 997}" for k in range(60_000))
    rows = [(1, long, 1), (2, None, 2), (None, "", 3), (2, "x", 4), (2, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 3)], "doc_id long, quality int, toxic int")
    for out in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels), rules.judge(docs, labels), lm.score_texts(docs)):
        assert out.count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(docs, labels).collect())
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(400, 430))), (None, "w1 w2 w3 w4 w5")], "item_id long, text string")
    assert [(r["doc_id"], r["start_word"]) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 400)]
    for out in (quality.score_quality(empty, labels), toxicity.score_toxicity(empty, labels), rules.judge(empty, labels), packing.pack(empty), lm.score_texts(empty), lm.unigram_base(empty)):
        assert out.count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>" + "long body " * 200_000, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert html.extract(pages.where("false")).count() == 0 and html.extract(pages).count() == 2
    assert sum(r["n_records"] for r in warc.audit(warc.archive(pages)).collect()) == 2


def test_common_words_are_bounded_whatever_their_counts(spark, monkeypatch):
    words = spark.range(4000).select(F.col("id").alias("h"), F.when(F.col("id") < 3000, 100_000).when(F.col("id") < 3400, 70).otherwise(F.col("id") % 5 + 1).cast("long").alias("c"))
    for most, least_rows in ((4000, 4000), (3500, 3400), (3200, 3000), (1000, 600), (200, 80), (1, 0)):
        monkeypatch.setattr(lm, "COMMON", most)
        monkeypatch.setattr(lm, "COUNTS", 50)
        kept = [r["c"] for r in words.where(lm.common_if(words)).collect()]
        assert least_rows <= len(kept) <= most
        rest = [r["c"] for r in words.where(~lm.common_if(words)).collect()]
        assert len(kept) + len(rest) == 4000 and (not kept or not rest or min(kept) >= max(rest))


def test_base_scores_do_not_depend_on_which_words_are_common(spark, corpus, monkeypatch):
    key = lambda df: sorted((str(r["doc_id"]), r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())
    docs = corpus[1].where("doc_id < 60 OR doc_id > 139")
    whole = key(lm.score_texts(docs, sample=20))
    monkeypatch.setattr(lm, "COMMON", 120)
    monkeypatch.setattr(lm, "COUNTS", 4)
    assert key(lm.score_texts(docs, sample=20)) == whole
