"""The trained operators: held-out accuracy, proper probabilities and the rows nobody expects."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import html, learn, lm, quality, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labelled(spark, make, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(k, make(rng, k % 4 == 0), int(k % 4 == 0)) for k in range(n)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1.0) for i, t, _ in rows] + [(9001, None, "", "", 0.0), (9002, "", "", "", 0.0), (None, "some text", "", "", 0.0), rows[0][:2] + ("xx", "s", 1.0)],
                                 "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def prose(rng, n=60):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(300)}" for _ in range(n)]


def check(frame, rows, fold):
    got = {}
    for r in frame.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1])
        got[r["doc_id"]] = r
    assert len(got) == len(rows) + 3
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    return sum(y == p for y, p in held) / len(held)


def test_toxicity_finds_stems(spark):
    def make(rng, bad):
        w = prose(rng)
        if bad:
            w[rng.randrange(len(w))] = "vile" + rng.choice(["st", "r", "", "ness!", "x9"])
        return " ".join(w)

    rows, docs, labels = labelled(spark, make, n=1600)
    assert check(toxicity.score_toxicity(docs, labels), rows, toxicity.FOLD) > 0.95
    assert toxicity.score_toxicity(docs, labels.where("false")).agg({"score": "max"}).first()[0] == 0
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_quality_sees_repetition(spark):
    def make(rng, good):
        return " ".join(prose(rng)) if good else " ".join(w for w in prose(rng, 6) for _ in range(10))

    rows, docs, labels = labelled(spark, make)
    assert check(quality.score_quality(docs, labels), rows, quality.FOLD) > 0.95
    assert quality.score_quality(docs, labels.where("false")).agg({"score": "min"}).first()[0] == 1
    assert quality.score_quality(docs.where("false"), labels).count() == 0


def test_scores_don_t_depend_on_batches():
    texts = pa.array([" ".join(prose(random.Random(k), 30)) for k in range(40)] + ["", "x", None])
    sample = learn.Sample(texts, np.arange(43) % 2.0, 0.3)
    model = toxicity.Convolution().fit(sample)
    assert np.allclose(model.scores(texts), np.concatenate([model.scores(texts.slice(k, 1)) for k in range(43)]), atol=1e-5)
    model = quality.PooledNetwork().fit(sample)
    assert np.allclose(model.scores(texts), np.concatenate([model.scores(texts.slice(k, 1)) for k in range(43)]), atol=1e-5)


def test_languages():
    texts = ["the cat and the dog of", "der Hund und die Katze", "le chat et les chiens", "el perro y los gatos", "", "zzz"]
    _, _, h, first, _, _ = learn.words_of(pa.array(texts))
    assert learn.language_of(h, first).tolist() == [0, 1, 2, 3, 4, 4]


# --- language model ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    nouns = [f"{a}{b}" for a in ("lom", "tar", "vin", "sel") for b in ("ba", "do", "ki", "", "ran")]
    rows = [(k, " ".join(rng.choice(nouns) if rng.random() < 0.7 else "the" for _ in range(rng.randrange(1, 90))).title()) for k in range(160)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "word " * 3000), (504, "x" * 3000), (1, rows[1][1]), (None, "the lomba")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h long")
    return rows, docs


@pytest.mark.parametrize("common", [1 << 18, 4])
def test_base_is_exact(scored, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON", common)
    rows, docs = scored
    words = lambda t: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for i, t in rows:
        own = [*words(t), None]
        expected[i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 6)] += 1
    got = lm.score_texts(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_no_training_texts(scored):
    assert lm.score_texts(scored[1].where("false")).count() == 0


def test_next_ids_sum_to_one(scored, monkeypatch):
    """The model's probabilities of everything that may follow a beginning."""
    kept = {}
    fit = lm.Attention.fit
    monkeypatch.setattr(lm.Attention, "fit", lambda self, docs, **k: kept.setdefault("model", fit(self, docs, **k)))
    lm.score_texts(scored[1])
    model, files = kept["model"], lm.tokenizer_files()
    by = model.tables()
    for text in ("the", "the lomba tarki the", "zq"):
        ids = lm.ids_of([text], files)[0]
        whole = model.scores([ids], by)[0]  # ends here
        every = [np.append(ids, k) for k in range(lm.VOCABULARY)]
        logs = []
        for k in range(0, len(every), 4096):
            part = every[k : k + 4096]
            # the score of a continuation without its end: p(ids + k) over what an end makes of it
            logs.append(_without_end(model, part, by))
        total = (10.0 ** np.concatenate(logs)).sum() + 10.0**whole
        begun = 10.0 ** _without_end(model, [ids], by)[0]
        assert abs(total / begun - 1) < 2e-3


def _without_end(model, docs, by):
    """log10 probabilities of the ids alone."""
    caught = {}
    log10 = np.log10

    def spy(x):
        caught["p"] = x
        return log10(x)

    lm.np.log10, back = spy, lm.np.log10
    try:
        model.scores(docs, by)
    finally:
        lm.np.log10 = back
    p, at, out = log10(caught["p"]), 0, []
    for ids in docs:
        out.append(p[at : at + len(ids)].sum())
        at += len(ids) + 1
    return np.array(out)


def test_windows_score_each_id_once(scored):
    b, a, first, _ = lm._blocks([np.arange(k) for k in (0, 1, 15, 16, 17, 40)], np.arange(60))
    assert first.tolist() == [0, 1, 2, 3, 5, 7, 10]
    assert [int((a[first[k] : first[k + 1]] >= 0).sum()) for k in range(6)] == [1, 2, 16, 17, 18, 41]
    assert (b >= 0).sum() == (a >= 0).sum()


# --- pages -------------------------------------------------------------------------------------------------


def test_extraction_of_unseen_layouts(spark):
    field = html.trained()
    pages = html.labelled_pages(120, seed=77)
    right = sum(field.decode(b, {}) == y for b, y in pages) / len(pages)
    assert right > 0.85
    page = """<!doctype html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><a href=/>Home</a> <a href=/b>More</a></nav>
    <div class="ad">Buy now &amp; save.</div><article><h1>A &lt;title&gt;</h1><p><b>First  part<br>goes&nbsp;on.<p>Second one ends here.</p><!-- x --></article>
    <section class="comments"><h2>Comments</h2><p>Nice read, thanks.</p></section><form><p>Subscribe</p><input></form><footer>&copy; 2020 Site</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<" * 2000 + '<a "'), (5, "u", "<div>" * 5000 + "deep"), (1, "u", page)]
    got = html.extract(spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text long, n_chars long"), field).collect()
    assert len(got) == 6 and [r["text"] for r in got if r["page_id"] == 1] == ["A <title>\n\nFirst part goes on.\n\nSecond one ends here."] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}


def test_viterbi_is_the_best_path():
    field = html.trained()
    for blocks, _ in html.labelled_pages(40, seed=5):
        blocks = blocks[:9]
        s = [sum(field.w.get(f, 0) for f in x) for x in field.features(blocks)]

        def value(y):
            return sum(a * b for a, b in zip(s, y)) + sum(field.t[a][b] for a, b in zip(y, y[1:]))

        best = max(([m >> k & 1 for k in range(len(blocks))] for m in range(1 << len(blocks))), key=value)
        assert abs(value(best) - value(field.decode(blocks, {}))) < 1e-9


# --- archives ----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [("1", "http://a/é", b"<p>x\r\n\r\n</p>"), ("2", "", b""), ("3", "u", bytes(range(256)))]
    for compress in (False, True):
        data = warc.write_warc(iter(rows), compress)
        found = list(warc.parse(data))
        assert [(h["WARC-Target-URI"], b) for _, _, h, b in found] == [(u, b) for _, u, b in rows]
        assert [o for o, *_ in found] == np.append(0, np.cumsum([n for _, n, *_ in found]))[:-1].tolist()
        (tmp_path / f"{compress}.warc").write_bytes(data)
    assert warc.read_warc(spark, str(tmp_path)).count() == 6
    with pytest.raises(ValueError):
        list(warc.parse(warc.write_warc(iter(rows), False)[:-20]))


def test_audit_finds_the_damage(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"u{k}", f"<p>{k}</p>" * (k % 7)) for k in range(1300)] + [(7, "u7", "again"), (8, None, None), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, hash long").repartition(3)
    clean = warc.audit(warc.archive(pages)).collect()
    assert sum(r["n_records"] for r in clean) == len(rows) and all(r["intact"] and not r["damaged"] and r["n_compared"] == 1 for r in clean)
    hurt = F.when(F.col("page_id").isin(3, 700, 701), F.concat(F.lit("!"), "html")).otherwise(F.col("html"))
    report = warc.audit(warc.archive(pages, hurt)).collect()
    assert sorted(x for r in report for x in r["damaged"]) == [3, 700, 701]
    assert sum(r["n_compared"] for r in report) < 200
    assert sum(r["n_bytes"] for r in report) == sum(len(warc.record_bytes("null" if i is None else str(i), u or "", (t or "").encode())) for i, u, t in rows)
    assert warc.audit(warc.archive(pages.where("false"))).count() == 0
