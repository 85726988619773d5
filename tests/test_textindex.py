"""The kept text index against searches that read all texts, through imports that replace and remove."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions.query import compile_query
from logloom.operators import search, textindex
from logloom.sources.scratch import written
from logloom.sources.store import Store

from .test_transcripts import line

EVENTS = "session_id long, seq long, role string, ts string, text string"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    bits = ["append", "only", "log", "Café", "cafe", "aaaa", "aaaaaa", "to", "tone", "I", "a", "ab", "ฉันรัก", "日本語テキスト", "x_y", "it's", "--", "😀😀😀😀", "İstanbul", "ment", "mentment"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(14))) + rng.choice(["", "\nlast line", "  "]) for _ in range(300)]
    texts += ["the append only log of the log " * 50, "a" * 3000, "ab", "abc"]
    rows = [(k % 60, k, "user", None, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, EVENTS)


QUERIES = ["append only", "log log", "aaa", "to", "a", "is to", "cafe", "日本語テキスト", "it's", "the append only log", "mentment ment", "append nowhere", "ab ", "--", "İsta", "a b", ""]


@pytest.mark.parametrize("engine", ["substring", "token"])
def test_scores_are_those_of_a_scan(spark, events, engine):
    postings, sessions = written(textindex.postings(events, 1), "kind", "part"), written(textindex.indexed(events, 1))
    for text in QUERIES:
        query = compile_query(text, engine)
        want = {(r["session_id"], r["seq"]): r["score"] for r in search.scored(events, query).collect()}
        got = {(r["session_id"], r["seq"]): r["score"] for r in textindex.scored(postings, sessions, query).collect()}
        assert got.keys() == want.keys(), text
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got), text


def test_a_search_reads_the_parts_of_its_terms(spark, events):
    postings = written(textindex.postings(events, 1), "kind", "part")
    rows = textindex.rows_of(postings, "token", textindex.slots_of(compile_query("append lo", "token"), 1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    part = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert "part#" in part[1] and str(textindex.part_of("token", "lo")) in part[1] and "StringStartsWith(term,lo)" in part[2]
    assert {r["part"] for r in rows.select("part").distinct().collect()} == {textindex.part_of("token", "lo")}
    assert rows.select(F.input_file_name()).distinct().count() <= textindex.SALTS
    assert textindex.postings(events.where("false"), 1).count() == 0 and textindex.scored(postings.where("false"), textindex.indexed(events.where("false"), 1), compile_query("append")).count() == 0


def test_an_index_follows_its_imports(spark, tmp_path):
    root, store = tmp_path / "corpus/p", Store(spark, str(tmp_path / "index"))
    root.mkdir(parents=True)
    for k in range(4):
        (root / f"u{k}.jsonl").write_text("\n".join([line("user", f"append only log {k} " * (k + 1), "2026-01-01T00:00:00Z"), line("assistant", "an answer of sorts")]) + "\n")
    store.init()
    assert not store.has_index()
    store.import_transcripts(str(root.parent), "t1", 1)

    def same():
        for text, engine in (("append", None), ("an", None), ("changed words", None), ("answer so", "token")):
            scan = search.search_filtered(store.read("events"), with_names(store), text, 50, engine)
            got = store.search(text, 50, engine)
            assert got.columns == [*scan.select("session_id", *[c for c in got.columns if c != "session_id"]).columns]
            key = lambda df: [(r["session_id"], r["seq"], round(r["score"], 9), r["text"], r["session_uuid"]) for r in df.collect()]
            assert key(got) == key(scan)
        return store.search("append").count()

    def with_names(store):
        from logloom.operators.sessions import with_projects

        return with_projects(store.read("sessions"), store.read("projects"))

    assert same() == 4 and store.has_index()
    (root / "u1.jsonl").write_text(line("user", "changed words alone") + "\n")
    (root / "u2.jsonl").write_text(line("mode") + "\n")
    store.import_transcripts(str(root.parent), "t2", 2)
    assert same() == 2 and store.read("postings").select("segment").distinct().count() == 2
    before = store.read("postings").count()
    store.compact_index()
    assert store.read("postings").count() < before and same() == 2
    store.index_events()
    assert same() == 2 and store.read("postings").select("segment").distinct().count() == 1
    assert store.search("append", tier="subagent").count() == 0 and store.search("append", 1).count() == 1


def test_many_searches_are_one_plan(spark, events):
    postings, sessions = written(textindex.postings(events, 1), "kind", "part"), written(textindex.indexed(events, 1))
    texts = ["append only", "log log", "aaa", "to", "a", "is to", "cafe", "the append only log", "append nowhere", "a b", ""]
    asked = [(k, compile_query(t)) for k, t in enumerate(texts)] + [(50, compile_query("only log", "token")), (51, compile_query("is to", "token"))]
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    counts = []
    for name, some in (("few", asked[:2]), ("many", asked)):
        spark.sparkContext.setJobGroup(name, name)
        rows = textindex.search_many(postings, sessions, some, 7).collect()
        counts.append(jobs(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 3  # a prefix takes one more join, not more for more queries
    for query_id, query in asked:
        want = [(r["session_id"], r["seq"], round(r["score"], 9)) for r in search.scored(events, query).orderBy("score", "session_id", "seq").limit(7).collect()]
        got = sorted((r["rank"], r["session_id"], r["seq"], round(r["score"], 9)) for r in rows if r["query_id"] == query_id)
        assert [x[0] for x in got] == list(range(1, len(want) + 1))
        assert sorted(x[3] for x in got) == sorted(x[2] for x in want)
        assert {x[1:3] for x in got if x[3] < want[-1][2]} == {x[:2] for x in want if x[2] < want[-1][2]}
    assert textindex.search_many(postings, sessions, [(0, compile_query(""))]).count() == 0
