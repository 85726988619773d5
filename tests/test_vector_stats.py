"""Kept statistics of vectors: merged, brought up to date by appends and replacements, and used by searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import vectors
from logloom.plans.api import Engine
from logloom.sources.store import Store


def frame(spark, rows):
    return spark.createDataFrame([(s, k, 0, m, c, len(v), [float(x) for x in v], f"text {k}") for s, k, m, c, v in rows], schemas.EVENT_VECTORS)


def test_products_are_those_of_centred_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    mean = x.mean(0)
    x[5], x[6] = mean, mean + 1e-9
    for renormalise in (True, False):
        side = vectors._centred_rows(rng.normal(size=(3, 16)), mean, renormalise).T
        want = vectors._centred_rows(x, mean, renormalise) @ side
        assert np.abs(vectors._products(x, mean, side, renormalise) - want).max() < 1e-9


def test_sums_merge_and_tell_the_mean(spark):
    rng = np.random.default_rng(2)
    rows = [(1, k, "ab"[k % 2], "chat" if k % 3 else None, rng.normal(size=4 if k % 5 else 3)) for k in range(60)]
    own = frame(spark, rows)
    parts = [vectors.vector_sums(own.where(F.col("seq") % 4 == k).repartition(3), "vector_class", "model") for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    told = {(r["vector_class"], r["model"]): r for r in vectors.merged_sums(whole, "vector_class", "model").collect()}
    for key in {(c, m) for _, _, m, c, _ in rows}:
        mine = [np.float32(v) for _, _, m, c, v in rows if (c, m) == key]
        for place in range(4):
            values = [v[place] for v in mine if len(v) > place]
            assert told[key]["counts"][place] == len(values) and abs(told[key]["sums"][place] - sum(map(float, values))) < 1e-6
    assert np.allclose(vectors.mean_of(whole).first()["mean"], vectors.mean_vector(own).first()["mean"], atol=1e-9)
    assert vectors.vector_sums(own.where("false"), "model").count() == 0 and vectors.mean_of(whole.where("false")).first()["mean"] == []


def test_a_search_with_kept_statistics_reads_the_vectors_once(spark):
    rng = np.random.default_rng(3)
    own = frame(spark, [(1, k, "m", "chat", rng.normal(size=8)) for k in range(200)])
    query = [float(x) for x in rng.normal(size=8)]
    mean = vectors.mean_vector(own).first()["mean"]
    key = lambda df: [(r["seq"], round(r["score"], 9)) for r in df.collect()]
    assert key(vectors.semantic_search(own, query, "m", 7, mean)) == key(vectors.semantic_search(own, query, "m", 7))
    flat = vectors.semantic_scores(own, spark.createDataFrame([(0, query)], "query_id int, vector array<double>"), renormalise=False)
    got = {r["seq"]: r["score"] for r in flat.collect()}
    x = np.array([r["vector"] for r in own.orderBy("seq").collect()])
    want = (x - x.mean(0)) @ (np.array(query) - x.mean(0))
    assert np.allclose([got[k] for k in range(200)], want, atol=1e-6)


def test_statistics_follow_what_is_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.init()
    texts = [f"a text about subject {k} that is long enough" for k in range(30)]
    store.append("events", spark.createDataFrame([(k, 0, "user", None, t) for k, t in enumerate(texts)], schemas.EVENTS))
    model = "hash/en/r1/64"

    def right(name=model):
        mine = store.read("event_vectors").where(F.col("model") == name)
        assert np.allclose(store.vector_mean(name), vectors.mean_vector(mine).first()["mean"], atol=1e-6)

    assert store.vector_mean(model) is None
    store.build_embeddings([model], "t", 1)
    right()
    store.append("events", spark.createDataFrame([(100, 0, "user", None, "one more text that is long enough")], schemas.EVENTS))
    store.build_embeddings([model], "t", 2)
    right()
    path = tmp_path / "load.jsonl"
    path.write_text("\n".join(f'{{"session_id": {k}, "seq": 0, "chunk_index": 0, "dim": 64, "vector": {[float(j == k) for j in range(64)]}, "text": "t"}}' for k in range(5)))
    store.load_vectors(str(path), model, "chat", "t", 3)
    right()
    store.load_vectors(str(path), "other", "chat", "t", 4)
    right("other")
    hits = Engine.of(store).call("semantic_search", {"query": "subject 3", "limit": 3}).count()
    assert hits == 0  # no session is stored for these events
    store.drop_legacy_vectors(["other"], [model])
    assert store.vector_mean("other") is None
    right()
    before = store.vector_mean(model)
    store.refresh_vector_stats()
    assert np.allclose(store.vector_mean(model), before, atol=1e-6)
    with pytest.raises(ValueError):
        store.drop_legacy_vectors([model], ["none"])
