"""Fill-in-the-middle against plain slicing, and read back."""

import hashlib
import random

from pyspark.sql import functions as F

from logloom.llm import fim


def test_offsets_rank_code_points_whatever_is_kept():
    rng, large, small = random.Random(1), fim.Offsets(), fim.Offsets(most=50)
    for _ in range(500):
        text = "".join(rng.choice("ab  \né日😀\ŕ") for _ in range(rng.randrange(60)))
        draws = rng.randrange(2**32), rng.randrange(2**32)
        want = (len(text), *sorted(d % (len(text) + 1) for d in draws))
        assert fim.ranked(text, draws, large) == want and fim.ranked(text, draws, small, block=7) == want
    assert len(small.kept) <= 50 + 60


def plain(doc, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"


def test_against_slicing(spark, corpus, empty):
    odd = ["a<P>b", "<S>", "x <M>", "<", "<P", "S><M", "😀" * 9, "\r\ńe", "<<S" * 40, " ", "é" * 70_000 + " " + "ab " * 50_000]
    rows = [(k, t) for k, t in corpus[0]] + [(10_000 + 7 * k + j, t) for k, t in enumerate(odd) for j in range(7)]
    # names clash with the operator's own
    frame = spark.createDataFrame([(k, t, 1, "f", 2, "o") for k, t in rows], "doc_id long, text string, n int, form string, c int, output string")
    out = fim.fill_in_middle(frame)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr((k, *plain(k, t))) for k, t in rows)
    assert sorted(repr((r["doc_id"], r["back"])) for r in got) == sorted(repr((k, t or "")) for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).count() == 0


def test_other_keys_marks_and_shares(spark):
    frame = spark.createDataFrame([(str(k), "some text " * 3) for k in range(50)], "key string, body string")
    assert {r["form"] for r in fim.fill_in_middle(frame, "key", "body", seed="x", percent=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(frame, "key", "body", percent=100, spm_percent=100).collect()} == {"spm"}
