"""Packing, links, repeats, leaks and rules against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, decontaminate, graph, jaccard, packing, repeats, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


# --- word hashes -------------------------------------------------------------------------------------------


def test_word_hashes_know_words_apart(monkeypatch):
    texts = ["a b  ab", "ab\n\x0bB", None, "", "x" * 50, " lead", "tail ", "é É", "x" * 49 + "y"]
    monkeypatch.setattr(common, "_CHUNK", 8)
    small = common.hash_words(*common.flat_utf8(pa.array(texts)))
    monkeypatch.undo()
    h, first, begin, end = common.hash_words(*common.flat_utf8(pa.array(texts)))
    assert (small[0] == h).all()
    found = [w for t in texts for w in WORD.findall(lower(t))]
    assert len(found) == len(h) and first.tolist() == np.append(0, np.cumsum([len(WORD.findall(t or "")) for t in texts])).tolist()
    assert len(set(found)) == len(set(h.tolist())) and len({(w, int(x)) for w, x in zip(found, h)}) == len(set(found))


# --- packing -----------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer_file(corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoding(*packing.tokenizer_files())
    for text in [t or "" for _, t in corpus[0]][-40:] + ["a <|endoftext|> b<|endoftext|>", "Ünï ßé 12'll\n\n  x", "กิ 日本"]:
        assert enc.encode(text, allowed_special="all") == hf.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("counts", [{5: 1}, {8: 3, 3: 2}, {7: 10, 1: 30, 4: 3}, {3: 100, 2: 7}, {k: k * 3 % 11 + 1 for k in range(1, 65)}])
def test_plan_places_everything_once(counts):
    capacity = 64 if max(counts) > 8 else 8
    fill, ranks = defaultdict(set), Counter()
    for length, rank, first, offset, n in packing.plan(counts, capacity).tolist():
        for k in range(n):
            place = set(range(offset, offset + length))
            assert not place & fill[first + k] and offset + length <= capacity
            fill[first + k] |= place
        ranks[length] += n
    assert ranks == Counter(counts)
    assert all(max(x) + 1 == len(x) for x in fill.values())  # gapless
    bins = []  # best fit, the longest first, one at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    assert len(fill) <= len(bins) * 1.05 + 1


def test_packing(corpus, empty):
    rows, frame = corpus
    got = packing.pack(frame, capacity=64).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc, text in rows:
        ids = np.array(hf.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            expected[(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    found = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert found == expected
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.append(0, np.cumsum(own.length))[:-1].tolist() and own.length.sum() <= 64
    assert packing.pack(empty).count() == 0


# --- components and links ----------------------------------------------------------------------------------


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("few,part", [(64, 4096), (3, 4)])
def test_jaccard_components(corpus, empty, monkeypatch, few, part):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "PART", part)
    rows, frame = corpus
    own = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            s, t = own[a][1], own[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(parent, a)] = find(parent, b)
    least = {}
    for k, (i, _) in enumerate(own):
        if i is not None:
            least[find(parent, k)] = min(i, least.get(find(parent, k), i))
    expected = Counter((i, len(s), least.get(find(parent, k))) for k, (i, s) in enumerate(own))
    got = Counter(tuple(r) for r in jaccard.jaccard_classes(frame).select("doc_id", "n_shingles", "component_id").collect())
    assert got == expected
    assert jaccard.jaccard_classes(empty).count() == 0


# --- repeated passages -------------------------------------------------------------------------------------


def brute_repeats(rows):
    """Words in windows of 50 that occur before, by (doc_id, place)."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        w = WORD.findall(t)
        for k in range(len(w) - repeats.LEAST + 1):
            g = tuple(w[k : k + repeats.LEAST])
            if g in seen:
                out.setdefault(i, set()).update(range(k, k + repeats.LEAST))
            seen.add(g)
    return out


def test_minimisers_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(0, 30, rng.integers(25, 300)).astype(np.uint64)
        pos = repeats.kept_suffixes(x)
        key = common.mix64(x ^ np.uint64(0xA0761D6478BD642F))
        assert set(pos) == {k for s in range(len(x) - repeats.WINDOW + 1) for k in range(s, s + repeats.WINDOW) if key[k] == key[s : s + repeats.WINDOW].min()}


def test_repeats(spark, empty):
    import random

    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(10**6)}"
    make = lambda n: [word() for _ in range(n)]
    shared, short = make(75), make(49)
    rows = [(k, " ".join(make(rng.randrange(0, 60)) + (shared if k % 3 else short) + make(rng.randrange(0, 60)))) for k in range(30)]
    rows += [(40, None), (41, ""), (42, rows[5][1]), (42, rows[5][1]), (43, " ".join(make(20_000) + shared)), (44, "\n".join(shared * 3)), (None, " ".join(shared))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, head long").repartition(5)
    got = defaultdict(set)
    for r in repeats.repeated_spans(frame).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert dict(got) == brute_repeats(rows)
    cut = {r["doc_id"]: r["text"] for r in repeats.without_repeats(frame).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        rest = [x for k, x in enumerate(w) if i is None or k not in got.get(i, ())]
        assert (WORD.findall(cut[i] or "") == rest) if i in cut else w and not rest
    assert repeats.repeated_spans(empty).count() == 0 and repeats.without_repeats(empty).count() == 0


# --- benchmark leaks ---------------------------------------------------------------------------------------


def grams(w):
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def test_leaks(spark, empty):
    import random

    rng = random.Random(8)
    make = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    items = [(k, " ".join(make(rng.randrange(12, 50)))) for k in range(12)] + [(20, None), (21, ""), (22, "two words"), (0, "  ")]
    rows = []
    for k in range(40):
        w = make(rng.randrange(0, 120))
        if k % 2:
            part = items[k % 12][1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                part[rng.randrange(len(part))] = "edit"
            if rng.random() < 0.2:
                part.insert(5, "more")
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        rows.append((k, " ".join(w).upper() if k % 5 == 0 else " ".join(w)))
    rows += [(50, None), (51, ""), (52, "Two  WORDS"), (53, "it has two words in it"), (None, items[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, n long, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, t in rows:
        w = (t or "").lower().split()
        for item, text in items:
            x = (text or "").lower().split()
            for s in range(max(1, len(w) - len(x) + 1)) if x and i is not None and (len(x) >= 5 or len(w) < 5) else ():
                a, b = grams(w[s : s + len(x)]), grams(x)
                both = sum((a & b).values())
                if both and 100 * both >= 75 * (sum(a.values()) + sum(b.values()) - both):
                    expected.add((i, item))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == expected
    kept = decontaminate.without_leaks(docs, bench)
    assert {r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()} == {i for i, _ in rows if i is not None} - {i for i, _ in expected} and kept.columns == docs.columns
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_leaks_run_no_python(spark, corpus):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = decontaminate.leaks(corpus[1], bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan


# --- quality rules -----------------------------------------------------------------------------------------


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    held = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held)


def test_statistics(spark, corpus):
    rows = corpus[0] + [(200, "a b c\na b c\n\na b c #$"), (201, "x x x x x"), (202, "p q r s p q r t q r s"), (203, "\n".join(["same line"] * 40))]
    frame = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, w long")
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.with_statistics(frame).collect())
    assert got == Counter((i, *base_counts(t)) for i, t in rows)


def test_rules_are_learned_and_emitted(spark, corpus):
    bad = [(1000 + k, " ".join(f"s{(k * 7 + j) % 90}$$$" for j in range(70)), 0) for k in range(60)]
    good = [(2000 + k, " ".join(f"t{(k * 7 + j * j) % 997}" for j in range(70)), 1) for k in range(90)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in bad + good], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in bad + good] + [(None, 0, 0), (1000, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in rules.judge(docs, labels).collect()}
    assert all(not rows[i]["kept"] and rows[i]["rule"] == 1 for i, _, _ in bad) and all(rows[i]["kept"] for i, _, _ in good)
    none = rules.judge(corpus[1], labels.where("false"))
    assert none.where("kept = base_failed").count() == 0 and none.count() == len(corpus[0])
    plan = none._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_literals_become_columns(spark):
    found = rules.learn([([0.0] * len(rules.FEATURES), 1)] * 30 + [([1.0] * len(rules.FEATURES), 0)] * 30)
    assert len(found) == 1 and len(found[0]) == 1 and str(found[0][0]).endswith("> 0.5")
    row = spark.range(1).select(*(F.lit(1.0).alias(f"__{k}") for k in rules.FEATURES)).select(rules.verdict(found).alias("r")).first()
    assert row["r"] == 1
