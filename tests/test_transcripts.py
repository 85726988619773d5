"""Files on disk: discovery, parsing, import and tailing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import blocks, query
from logloom.plans.api import COMMANDS, Engine, Refused
from logloom.sources import tail, transcripts
from logloom.streaming import live


def line(kind, text=None, ts=None, **more):
    out = {"type": kind, **more}
    if text is not None:
        out["message"] = {"role": kind, "content": text}
    if ts:
        out["timestamp"] = ts
    return json.dumps(out)


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"

    def put(path, *lines, end="\n"):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(lines) + end)

    put(
        "proj/u1.jsonl", line("user", "hello  world", "2024-01-02T00:00:00Z", cwd="/home/a"), "", "{broken",
        line("assistant", [{"type": "text", "text": "first"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/x"}}, {"type": "text", "text": "second"}], "2024-01-01T00:00:00Z"),
        line("mode"), end="",
    )
    put("proj/u1/subagents/agent-a1.jsonl", line("user", "sub"))
    put("proj/u1/subagents/workflows/wf_9/agent-b2.jsonl", line("assistant", "flow"))
    put("proj/u1/subagents/workflows/wf_9/journal.jsonl", line("user", "no"))
    put("proj/u1/deep/other/x.jsonl", line("user", "no"))
    put("proj2/u2.jsonl", "not json at all")
    put("proj2/u3.jsonl", end="")  # not listed while empty
    return str(root)


def test_discovery_has_three_tiers(spark, corpus):
    rows = {r["file_path"].split("corpus/")[1]: r for r in transcripts.discover_files(spark, corpus).collect()}
    assert {k: v["file_tier"] for k, v in rows.items()} == {
        "proj/u1.jsonl": "session", "proj/u1/subagents/agent-a1.jsonl": "subagent", "proj/u1/subagents/workflows/wf_9/agent-b2.jsonl": "workflow_agent",
        "proj2/u2.jsonl": "session",
    }
    flow = rows["proj/u1/subagents/workflows/wf_9/agent-b2.jsonl"]
    assert (flow["session_uuid"], flow["agent_id"], flow["workflow_run_id"]) == ("u1", "b2", "wf_9")
    assert "content" not in transcripts.discover_files(spark, corpus)._jdf.queryExecution().executedPlan().toString()


def test_lines_skip_blanks_and_keep_order(spark, corpus):
    lines = transcripts.parse_sessions(spark, corpus + "/proj/u1.jsonl")
    assert [(r["seq"], r["line_type"], r["text"]) for r in lines.orderBy("seq").collect()] == [
        (0, "user", "hello  world"), (1, None, None), (2, "assistant", "first\nsecond"), (3, "mode", None),
    ]
    s = transcripts.session_summaries(lines).first()
    assert (s["line_count"], s["event_count"], s["started_at"], s["ended_at"], s["cwd"], s["description"]) == (
        4, 2, "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", "/home/a", "hello  world",
    )
    assert transcripts.first_cwd(transcripts.discover_files(spark, corpus).where("session_uuid = 'u1' AND file_tier = 'session'")).first()["cwd"] == "/home/a"


def test_import_is_incremental(spark, corpus, tmp_path):
    known = spark.createDataFrame([], schemas.SESSIONS)
    first = transcripts.incremental_import(spark, corpus, known, "now", str(tmp_path / "s1"))
    assert first.counts == {"files_scanned": 4, "files_new": 4, "files_changed": 0, "files_skipped": 0, "files_failed": 1}
    rows = {r["file_path"].split("corpus/")[1]: r for r in first.sessions.collect()}
    assert rows["proj2/u2.jsonl"]["import_status"] == "failed"
    assert rows["proj/u1/subagents/agent-a1.jsonl"]["parent_session_id"] == rows["proj/u1.jsonl"]["id"]
    assert first.events.count() == 4
    stored = spark.createDataFrame(first.sessions.collect(), first.sessions.schema)
    second = transcripts.incremental_import(spark, corpus, stored, "later", str(tmp_path / "s2"))
    assert second.counts["files_skipped"] == 3 and second.counts["files_changed"] == 1  # the failed one again
    assert transcripts.incremental_import(spark, corpus, stored, "later", str(tmp_path / "s3"), only=["none"]).counts["files_scanned"] == 0
    assert transcripts.replace_by_key(stored, second.sessions, "id").count() == 4
    projects = transcripts.upsert_projects(first.projects.withColumn("cwd", F.lit("/first")), second.projects)
    assert {r["cwd"] for r in projects.collect()} == {"/first"}


def test_rollouts(spark, tmp_path):
    p = tmp_path / "2024/01/rollout-2024-01-01T00-00-00-aa-bb-cc-dd-ee.jsonl"
    p.parent.mkdir(parents=True)
    rows = [
        {"type": "session_meta", "timestamp": "t0", "payload": {"cwd": "/w", "parent_thread_id": "par"}},
        {"type": "response_item", "timestamp": "t1", "payload": {"type": "message", "role": "developer", "content": [{"type": "text", "text": "rules"}]}},
        {"type": "response_item", "timestamp": "t2", "payload": {"type": "message", "role": "user", "content": [{"type": "text", "text": "ask\nmore"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "sh", "arguments": "ls"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "files"}},
        {"type": "response_item", "payload": {"type": "reasoning"}},
    ]
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\nbad\n" + '{"type":"x","timestamp":"t9"')
    head = transcripts.rollout_headers(transcripts.parse_rollouts(spark, str(p))).first()
    assert (head["session_uuid"], head["cwd"], head["parent_uuid"], head["file_tier"]) == ("aa-bb-cc-dd-ee", "/w", "par", "subagent")
    lines = transcripts.parse_rollouts(spark, str(p))
    texts = [(r["seq"], r["role"], r["text"]) for r in lines.where("text IS NOT NULL").orderBy("pos").collect()]
    assert texts == [(0, "developer", "rules"), (1, "user", "ask\nmore"), (2, "tool_use", "sh · ls"), (3, "tool_result", "files")]
    assert lines.where("line_type = '(malformed)'").count() == 1
    s = transcripts.rollout_summaries(lines).first()
    assert (s["event_count"], s["started_at"], s["ended_at"], s["description"]) == (4, "t0", "t2", "ask")


def test_tail_holds_partial_lines_back(tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes(b"one\ntwo\npart")
    rows, at, truncated, more = tail.read_lines(str(p), 0)
    assert (rows, at, truncated, more) == ([(0, "one"), (4, "two")], 8, False, True)
    assert tail.read_lines(str(p), 8)[:2] == ([], 8)
    with p.open("ab") as f:
        f.write(b"ial\n")
    assert tail.read_lines(str(p), 8)[0] == [(8, "partial")]
    p.write_bytes(b"new\n")
    assert tail.read_lines(str(p), 16)[:3] == ([(0, "new")], 4, True)
    assert tail.read_lines(str(p), 0, cap=2)[0] == [(0, "new")]  # the window grows to the newline
    assert tail.aligned(str(p), 1) == 4 and tail.history(str(p), 4) == ([(0, "new")], True)


def test_tail_stream_resumes(spark, tmp_path):
    path, got = tmp_path / "logs", []
    path.mkdir()
    (path / "a.jsonl").write_text(line("user", "one") + "\n" + "{oops\n" + '{"type":')

    def run():
        events = live.to_events(live.tail(spark, str(path / "*.jsonl"), start="begin"))
        q = live.watch(events, str(tmp_path / "ckpt"), lambda df, _: got.extend((r["parsed"], r["role"], r["text"]) for r in df.orderBy("offset").collect()), once=True)
        assert q.awaitTermination(60)

    run()
    assert got == [(True, "user", "one"), (False, None, "{oops")]
    with (path / "a.jsonl").open("a") as f:
        f.write('"mode"}\n')
    got.clear()
    run()
    assert got == [(True, None, "mode")]


@pytest.mark.parametrize(
    "text,expected",
    [("cd /a && sudo env X=1 /usr/bin/git status", "git"), ("export A=1; ls -l | wc", "ls"), ("", None), ("FOO=bar", None), ("time make -j", "make")],
)
def test_shell_program(text, expected):
    assert blocks.shell_program_of(text) == expected


def test_summaries(spark):
    content = [{"type": "tool_use", "name": "Bash", "input": {"command": "ls\nrm"}}, {"type": "tool_result", "is_error": True}, {"type": "thinking", "thinking": "x" * 80}]
    df = spark.createDataFrame([(line("assistant", content),), (line("user", "plain"),)], "l string").select(F.parse_json("l").alias("v"))
    rows = [r["s"] for r in df.select(blocks.summarize(blocks.block_array(F.col("v"))).alias("s")).collect()]
    assert rows == ["Bash · ls   → error   thinking… " + "x" * 64 + "…", None]


def test_query_compilation():
    assert query.compile_query("a b").phrases == ()  # long enough for substring search, all words too short
    assert query.compile_query("go fox").phrases == ("fox",)
    assert query.compile_query("go").engine == "token" and query.compile_query("go").prefix
    from datetime import datetime, timezone

    now = datetime(2024, 5, 5, 12, tzinfo=timezone.utc)
    assert query.parse_since("2h", now) == int(now.timestamp()) - 7200
    assert [query.parse_since(x, now) for x in ("all", "", "0d", "1999-01-01", "x", "99999999d")] == [None] * 6
    assert query.parse_since("2024-05-01", now) == 1714521600


def test_phrases_against_fts5(spark):
    import sqlite3

    texts = ["append-only log", "only append", "Café append only", "append only append only", "nothing here"] + [f"filler row {k}" for k in range(20)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", enumerate(texts))
    from logloom.operators import search

    events = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "session_id long, seq long, role string, text string")
    for text, match in (("append-only", '"append-only"*'), ("cafe app", '"cafe" "app"*')):
        expected = {r: s for r, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        got = {r["session_id"]: r["score"] for r in search.search(events, text, engine="token").collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_engine_validates_and_answers(spark):
    from logloom.plans import demo

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the generated tables")
    e = Engine(spark, demo.sessions(spark, d), demo.projects(spark, d), demo.events(spark, d))
    assert e.call("search_sessions", {"query": "tion", "limit": 5}).count() == 5
    assert e.call("list_sessions", {"sort": "size"}).count() == 40
    for name, args in (("list_sessions", {"sort": "rowid; DROP"}), ("search_sessions", {}), ("search_sessions", {"query": "x", "extra": 1}), ("list_sessions", {"limit": 0}), ("nope", {})):
        with pytest.raises(Refused):
            e.call(name, args)
    assert e.trace_topic("t", "tion", at="now").count() > 0
    assert e.call("dig_topic", {"name": "t", "refresh": False, "limit": 3}).count() == 3
    assert e.promote_topic("t").first()["promoted"] and e.forget_topic("t").count() == 0
    assert all(c.json_schema()["type"] == "object" for c in COMMANDS.values())


def test_embeddings_round_trip(spark, tmp_path):
    import numpy as np

    from logloom.operators import vectors

    events = spark.createDataFrame([(1, 0, "user", "word " * 130), (1, 1, "assistant", "short"), (2, 0, "tool_use", "x" * 40), (2, 1, "user", "exactly enough characters")], "session_id long, seq long, role string, text string")
    none = spark.createDataFrame([], schemas.EVENT_VECTORS)
    models = ["hash/en/r1/64"]
    made = vectors.build_embeddings(events, none, models).collect()
    assert sorted((r["session_id"], r["seq"], r["chunk_index"], r["model"]) for r in made) == [(1, 0, 0, models[0]), (1, 0, 1, models[0]), (2, 1, 0, models[0])]
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-5 for r in made)
    stored = spark.createDataFrame([{**r.asDict(), "vector": [float(x) for x in r["vector"]]} for r in made], schemas.EVENT_VECTORS)
    assert vectors.unembedded(events, stored, models).count() == 0
    vectors.dump_chunks(events, none, models, str(tmp_path / "dump"))
    dumped = spark.read.json(str(tmp_path / "dump"))
    assert dumped.count() == 3
    rows = [{"session_id": 1, "seq": 0, "chunk_index": 0, "dim": 2, "vector": [3.0, 4.0]}, {"session_id": 1, "seq": 0, "chunk_index": 0, "dim": 2, "vector": [0.0, 2.0]},
            {"session_id": 1, "seq": 1, "chunk_index": 0, "dim": 2, "vector": [0.0, 0.0]}, {"session_id": 1, "seq": 2, "chunk_index": 0, "dim": 3, "vector": [1.0]}]
    (tmp_path / "load.json").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    good, refused = vectors.load_vectors(spark, str(tmp_path / "load.json"), "m", "chat")
    assert [list(r["vector"]) for r in good.collect()] == [[0.0, 1.0]]
    assert sorted(r["reason"] for r in refused.collect()) == ["missing field", "wrong dimension", "zero vector"]
    q = [float(x) for x in vectors.hashing_provider(__import__("pandas").Series(["exactly enough characters"]))[0]]
    assert vectors.semantic_search(stored, q, models[0], 1).first()["session_id"] == 2
