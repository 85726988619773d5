"""Cases in which an operator once did less than its whole job."""

import random
from collections import Counter, defaultdict

import pytest

from logloom.llm import html, repeats, warc

from .test_text_operators import brute_repeats


def found_repeats(frame):
    got = defaultdict(set)
    for r in repeats.repeated_spans(frame).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    return dict(got)


def test_repeats_with_more_partitions_than_suffixes(spark):
    rng = random.Random(21)
    make = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    shared = make(70)
    rows = [(k, " ".join(make(5) + shared + make(5))) for k in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        assert found_repeats(frame) == brute_repeats(rows)
    finally:
        spark.conf.set(key, before)


def test_repeats_whose_neighbour_shares_less(spark):
    rng = random.Random(22)
    make = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(12):  # a passage, a part of it with edits around, the passage again
        passage = make(58)
        at = k + 8
        part = make(20) + passage[at : at + 30] + make(20)
        rows += [(3 * k, " ".join(make(9) + passage + make(9))), (3 * k + 1, " ".join(part)), (3 * k + 2, " ".join(make(4) + passage + make(9)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    assert len(want) == 12 and found_repeats(frame) == want


def test_audit_of_two_archives(spark, tmp_path):
    rows = [(str(k), f"u{k}", b"<p>%d</p>" % k) for k in range(600)]
    other = {f: list(r) for f, r in (("a", rows[:580]), ("b", rows[580:]))}
    del other["a"][30]  # lost
    other["a"][40] = (*other["a"][40][:2], b"<p>")  # record 41, cut short
    other["b"].append(other["a"].pop(100))  # record 101, moved to the other file
    other["b"].insert(2, ("new", "u", b"more"))
    for name, files in (("one", {"a": rows[:580], "b": rows[580:]}), ("two", other)):
        (tmp_path / name).mkdir()
        for file, own in files.items():
            (tmp_path / name / f"{file}.warc.gz").write_bytes(warc.write_warc(iter(own)))
    leaves = [warc.leaves_of(warc.read_warc(spark, str(tmp_path / n)), f"/{n}/") for n in ("one", "two")]
    report = {r["file"]: r for r in warc.audit(*leaves).collect()}
    key = lambda *k: [f"<urn:page:{x}>" for x in k]
    a, b = report["a.warc.gz"], report["b.warc.gz"]
    assert a["damaged"] == key(30, 41) and a["missing"] == key(30) and a["added"] == [] and "<urn:page:101>" in a["moved"]
    assert b["damaged"] == [] and b["added"] == key("new") and not b["intact"] and a["n_records"] == 580
    same = warc.audit(leaves[0], leaves[0]).collect()
    assert len(same) == 2 and all(r["intact"] and r["n_compared"] == 1 for r in same)


def texts(page):
    return [b.text for b in html.blocks(page)]


def test_attributes_hide_by_name():
    shown = ['<p data-title="The hidden cost">x</p>', '<p class="text hidden md:block">x</p>', "<p title='aria-hidden=true'>x</p>", '<p style="display:block">x</p>', "<p aria-hidden=false>x</p>"]
    gone = ["<p hidden>x</p>", '<p HIDDEN="">x</p>', '<p class=a style="color:red; display: none">x</p>', "<p aria-hidden='true'>x</p>", "<div hidden><p>x</div>"]
    assert [texts(p) for p in shown] == [["x"]] * len(shown) and [texts(p) for p in gone] == [[]] * len(gone)
    assert texts("<p>a <math><mi>b</mi></math> <object>c</object> <canvas>d</canvas></p><noscript>e</noscript>") == ["a b c d", "e"]


def test_elements_nest_however_deep():
    page = "<div>" * 3000 + "deep<p>more" + "</div>" * 3000 + "<p>after</p>" + "</b></section>" * 3000 + "<p>end"
    assert texts(page) == ["deep", "more", "after", "end"]
    assert html.blocks("<div class=a>" * 2000 + "<p>x</p>" + "</div>" * 2000 + "<p>y</p>")[-1].above == {"t:p"}


#: Pages written by hand, whose layouts the generator of the labelled pages does not make, and their articles.
WRITTEN = [
    ("""<html><body><table><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr><tr><td width=150><b>Sections</b><br><a href=/1>Politics</a><br><a href=/2>Sport</a></td>
      <td><h2>Bridge reopens after repairs</h2><p>The old bridge was opened again on Monday, after eight months of work on its piers.</p><p>Engineers had found cracks in two of them last spring, and traffic was sent by way of the ferry.</p></td></tr>
      <tr><td colspan=2>Copyright 1999 The Valley Paper. All rights reserved.</td></tr></table></body></html>""",
     ["Bridge reopens after repairs", "The old bridge was opened again on Monday, after eight months of work on its piers.", "Engineers had found cracks in two of them last spring, and traffic was sent by way of the ferry."]),
    ("""<!doctype html><html><head><title>x</title><style>p{}</style></head><body><header class="site-header"><nav><ul><li><a href=/a>Start</a><li><a href=/b>Archive</a></ul></nav></header><main><article class="post"><h1>How bread rises</h1>
      <p>Yeast feeds on the sugar in flour and gives off gas. The dough holds the gas because kneading has made it elastic.</p><blockquote>Good bread needs time more than work.</blockquote><ul><li>Mix flour, water and salt, and let them rest for half an hour.</li><li>Fold the dough every hour until it is smooth.</li></ul>
      <p>Bake it hot, and let it cool before you cut it.</p></article></main><aside class="sidebar"><h3>Popular posts</h3><ul><li><a href=/p>Ten soups</a></li></ul></aside><footer><p>Subscribe to our newsletter</p><p>&copy; 2021 Kitchen notes</p></footer></body></html>""",
     ["How bread rises", "Yeast feeds on the sugar in flour and gives off gas. The dough holds the gas because kneading has made it elastic.", "Good bread needs time more than work.",
      "Mix flour, water and salt, and let them rest for half an hour.", "Fold the dough every hour until it is smooth.", "Bake it hot, and let it cool before you cut it."]),
    ("""<div id=page><div id=cookie-banner>We use cookies. <button>Accept</button></div><div id=nav><a href=1>One</a><a href=2>Two</a></div><div id=content><div class=entry><h1>A walk along the coast</h1><p>We left the harbour early, while the boats were still coming in, and followed the path over the cliffs.</p>
      <p>By noon the wind had turned, and we could see the island clearly across the strait.</p></div><div id=comments><h3>2 comments</h3><div class=comment><p>Lovely photos, thanks!</p></div><div class=comment><p>I was there last year.</p></div></div></div><div id=footer>Privacy policy | Terms of use</div></div>""",
     ["A walk along the coast", "We left the harbour early, while the boats were still coming in, and followed the path over the cliffs.", "By noon the wind had turned, and we could see the island clearly across the strait."]),
]


def test_pages_written_by_hand(spark):
    """Words of the articles found, and words found that are of them."""
    field = html.trained()
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([(k, "u", p) for k, (p, _) in enumerate(WRITTEN)], "page_id long, url string, html string"), field).collect()}
    for k, (_, article) in enumerate(WRITTEN):
        want, found = " ".join(article).split(), got[k].split()
        both = sum((Counter(want) & Counter(found)).values())
        assert both >= 0.9 * len(want) and both >= 0.85 * len(found), (k, got[k])


def test_audit_of_a_failing_replica_against_all_records(spark):
    """What the query audits: records lost, repeated, moved, cut short and rotten, found by comparing every record."""
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from logloom.llm import warc

    key = F.col("id")
    pages = spark.range(9000).select(key.alias("page_id"), F.concat(F.lit("http://x/"), key % 700).alias("url"), F.concat(F.lit("<p>"), F.repeat(F.lit("body "), (key % 30).cast("int")), key.cast("string")).alias("html"))
    pages = pages.unionByName(pages.where("page_id IN (5, 6)")).unionByName(spark.createDataFrame([(None, "u", "same"), (None, "u", "same"), (None, None, None)], "page_id long, url string, html string"))
    leaves = warc.materialise(warc.archive(pages, warc.failing(F.col("page_id"), F.col("html"))))
    replica = warc.scattered(leaves)
    ours = {(r["file"], r["i"]): r for r in leaves.collect()}
    theirs = {(r["file"], r["i"]): r for r in replica.collect()}
    assert len(ours) == 9005 and len(theirs) != len(ours)
    differs = [p for p in ours.keys() | theirs.keys() if (ours[p]["hash"] if p in ours else None) != (theirs[p]["hash"] if p in theirs else None)]
    mine, others = ([side[p] for p in sorted(differs) if p in side] for side in (ours, theirs))

    def pair(a, b, by):
        left, pairs = defaultdict(list), []
        for r in b:
            left[by(r)].append(r)
        rest = []
        for r in a:
            (pairs if left[by(r)] else rest).append((r, left[by(r)].pop(0)) if left[by(r)] else r)
        return pairs, rest, [r for x in left.values() for r in x]

    moved, mine, others = pair(mine, others, lambda r: (r["page_id"], r["hash"]))
    changed, missing, added = pair(mine, others, lambda r: r["page_id"])
    want = defaultdict(lambda: defaultdict(Counter))
    for name, some in (("moved", [a for a, _ in moved]), ("damaged", [a for a, _ in changed] + missing), ("missing", missing), ("added", added)):
        for r in some:
            want[r["file"]][name][r["page_id"]] += 1
    assert min(len(moved), len(changed), len(missing), len(added)) > 0
    rows = warc.audit(leaves, replica).collect()
    assert {r["file"] for r in rows} == {f for f, _ in ours.keys() | theirs.keys()}
    for r in rows:
        for name in ("moved", "damaged", "missing", "added"):
            assert Counter(r[name]) == want[r["file"]][name], (r["file"], name)
        assert r["intact"] == (not want[r["file"]]["damaged"])


def test_ids_are_the_tokenizer_files_for_a_whole_table():
    import os

    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from logloom.llm import packing

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the generated tables")
    texts = [t or "" for t in pq.read_table(path).column("text").to_pylist()]
    enc, file = packing.encoding(*packing.tokenizer_files()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, file.encode_batch(texts, add_special_tokens=False)):
        assert enc.encode(text, allowed_special="all") == ids.ids
