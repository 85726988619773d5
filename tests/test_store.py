"""From files to stored tables: imports, rollouts, vectors, graphs, the live model and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from logloom import __main__ as cli
from logloom import schemas
from logloom.operators import graph, vectors
from logloom.operators import sessions as ops
from logloom.plans.api import Engine, Refused
from logloom.sources import tail, transcripts
from logloom.sources.store import Store, exists
from logloom.streaming import live

from .test_transcripts import line


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "corpus"
    files = {
        "proj a+b/u1.jsonl": [line("user", "hello there my world", "2026-01-01T00:00:00Z", cwd="/home/a"), line("assistant", "an answer of some length")],
        "proj a+b/u1/subagents/agent-a1.jsonl": [line("user", "sub question of some length")],
        "proj2/u2.jsonl": [line("user", "other words entirely, long enough")],
    }
    for path, lines in files.items():
        p = base / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(lines) + "\n")
    return base


def test_imports_are_stored_and_logged(spark, root, tmp_path):
    index = str(tmp_path / "index")
    assert not exists(spark, index)
    store = Store(spark, index)
    store.init()
    assert exists(spark, index) and store.read("sessions").count() == 0
    first = store.import_transcripts(str(root), "t1", 1)
    assert (first["files_new"], first["files_failed"]) == (3, 0)
    rows = {r["session_uuid"] + str(r["agent_id"] or ""): r for r in store.read("sessions").collect()}
    assert rows["u1agent-a1"]["parent_session_id"] == rows["u1"]["id"] and rows["u1"]["description"] == "hello there my world"
    assert store.read("events").count() == 4 and store.read("session_type_counts").count() == 4
    assert {r["dir_name"]: r["cwd"] for r in store.read("projects").collect()} == {"proj a+b": "/home/a", "proj2": None}
    # a changed file replaces its rows, a failed one keeps what was known
    (root / "proj2/u2.jsonl").write_text("broken now\n")
    with (root / "proj a+b/u1.jsonl").open("a") as f:
        f.write(line("user", "more") + "\n")
    second = store.import_transcripts(str(root), "t2", 2)
    assert (second["files_changed"], second["files_skipped"], second["files_failed"]) == (2, 1, 1)
    rows = {r["file_path"].rsplit("/", 1)[1]: r for r in store.read("sessions").collect()}
    assert rows["u2.jsonl"]["import_status"] == "failed" and rows["u2.jsonl"]["description"] == "other words entirely, long enough" and rows["u2.jsonl"]["event_count"] == 1
    assert rows["u1.jsonl"]["event_count"] == 3 and store.read("events").count() == 5  # those of the failed file stay
    runs = {r["id"]: r for r in store.runs("import_runs").collect()}
    assert runs[2]["finished_at"] == "t2" and runs[1]["files_new"] == 3
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        store.import_transcripts(str(root / "none"), "t3", 3)
    store._log("import_runs", id=4, started_at="t4", files_scanned=1)
    assert [r["id"] for r in store.runs("import_runs").where("finished_at IS NULL").collect()] == [4]
    one = rows["u1.jsonl"]["id"]
    assert store.session_events(one).count() == 3 and "bucket" in store.session_events(one)._jdf.queryExecution().executedPlan().toString()
    scan = transcripts.probe_cwd(ops.project_scan(transcripts.discover_files(spark, str(root)).withColumn("state", F.lit("new"))))
    assert {r["dir_name"]: r["cwd"] for r in scan.collect()} == {"proj a+b": "/home/a", "proj2": None}
    # a session that comes to have no event leaves its bucket empty
    (root / "proj2/u2.jsonl").write_text(line("mode") + "\n")
    store.import_transcripts(str(root), "t5", 5)
    assert store.read("events").count() == 4 and store.read("session_type_counts").where("line_type = 'mode'").count() == 1
    store.views()
    assert spark.sql("SELECT count(*) AS n FROM events").first()["n"] == 4


def test_rollouts_link_to_their_parents(spark, tmp_path):
    base = tmp_path / "rollouts/2026/01"
    base.mkdir(parents=True)

    def put(uuid, **meta):
        rows = [{"type": "session_meta", "timestamp": "t0", "payload": {"id": uuid, "cwd": "/w", **meta}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "ask " + uuid}}]
        (base / f"rollout-2026-01-01T00-00-00-{uuid}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")

    put("aa-bb-cc-dd-ee")
    put("aa-bb-cc-dd-ff", parent_thread_id="aa-bb-cc-dd-ee", agent_nickname="nick")
    store = Store(spark, str(tmp_path / "index"))
    store.init()
    assert store.import_rollouts(str(tmp_path / "rollouts"), "t1")["files_new"] == 2
    rows = {r["session_uuid"]: r for r in store.read("sessions").collect()}
    child, parent = rows["aa-bb-cc-dd-ff"], rows["aa-bb-cc-dd-ee"]
    assert child["parent_session_id"] == parent["id"] and child["file_tier"] == "subagent" and child["agent_id"] == "nick" and child["source"] == "codex"
    assert parent["description"] == "ask aa-bb-cc-dd-ee" and parent["file_tier"] == "session" and store.read("projects").first()["cwd"] == "/w"
    assert store.import_rollouts(str(tmp_path / "rollouts"), "t2")["files_skipped"] == 2
    files = transcripts.rollout_files(spark, str(tmp_path / "rollouts"))
    heads = transcripts.rollout_headers(transcripts.parse_rollouts(spark, [r["file_path"] for r in files.collect()]))
    totals, folders = transcripts.rollout_scan(files, heads)
    assert tuple(totals.first())[0::2] == (2, 2) and totals.first()["with_parent"] == 1 and tuple(folders.first()) == ("/w", 2)


def test_vectors_are_stored_and_found(spark, root, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.init()
    store.import_transcripts(str(root), "t", 1)
    models = ["hash/en/r1/64"]
    counts = store.build_embeddings(models, "t", 5)
    assert counts["events"] == 3 and store.build_embeddings(models, "t", 6)["vectors"] == 0
    stored = store.read("event_vectors")
    assert {r["vector_class"] for r in stored.collect()} == {"chat"} and store.runs("vector_runs").where("id = 5").first()["vectors"] == counts["vectors"]
    engine = Engine.of(store, roots={"own": str(root)})
    hit = engine.call("semantic_search", {"query": "other words entirely, long enough", "limit": 1}).first()
    assert hit["session_uuid"] == "u2" and hit["project"] == "proj2"
    one = {"session_id": 9, "seq": 0, "chunk_index": 0, "dim": 2, "vector": [3.0, 4.0], "text": "x"}
    (tmp_path / "v.json").write_text(json.dumps(one) + "\n" + json.dumps({**one, "dim": 3}) + "\n")
    assert store.load_vectors(str(tmp_path / "v.json"), "m", "chat", "t", 7) == (1, 1) == store.load_vectors(str(tmp_path / "v.json"), "m", "chat", "t", 8)
    assert store.read("event_vectors").where("model = 'm'").count() == 1
    store.drop_legacy_vectors(["m"], models)
    assert store.read("event_vectors").where("model = 'm'").count() == 0
    with pytest.raises(ValueError):
        vectors.drop_legacy(stored, store.read("events"), models, ["another"])
    # topics live in the store and stay small plans
    assert engine.trace_topic("t", "length", at="now").count() > 0 and engine.call("promote_topic", {"name": "t"}).count() == 1
    assert engine.call("dig_t", {"limit": 1, "refresh": False}).count() == 1 and "dig_t" in {c.name for c in engine.tools()}
    assert engine.call("describe_tool", {"name": "dig_t"}).count() == 2 and store.read("topic_hits").count() > 0
    assert engine.call("import_index", {"corpus": "own"}).first()["files_skipped"] == 3
    for name, args in (("import_index", {"corpus": "no"}), ("import_index", {"since": "x"}), ("promote_topic", {"name": "no"}), ("dig_none", {})):
        with pytest.raises(Refused):
            engine.call(name, args)
    uuid = engine.sessions.where("event_count = 2").first()["session_uuid"]
    page = engine.call("read_session", {"session": uuid, "limit": 1}).collect()
    assert len(page) == 1 and page[0]["more"] and page[0]["shown"].startswith("#0 user 2026-01-01T00:00:00\n")


def test_graph_of_a_file(spark, tmp_path):
    call = lambda *uses: line("assistant", [{"type": "tool_use", "name": n, "input": i} for n, i in uses])
    lines = [
        call(("Early", {"path": "/no"})), line("user", "first ask\nmore"), call(("Read", {"path": "/a"}), ("Bash", {"command": "cd /x && make"})), line("user", [{"type": "tool_result"}]),
        call(("Read", {"path": "/b"})), line("user", "second"), call(("Read", {"path": "/a"}), ("Think", {})), "{broken",
    ]
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(lines) + "\n" + '{"type":"user"')
    nodes, edges = graph.session_graph(graph.graph_lines(spark, str(path)))
    got = [(r["kind"], r["label"], r["weight"]) for r in nodes.orderBy("node").collect()]
    assert got == [("beat", "first ask", 1), ("tool", "Read", 3), ("target", "/a", 4), ("tool", "Bash", 1), ("target", "$ make", 1), ("target", "/b", 1), ("beat", "second", 1), ("tool", "Think", 1)]
    kinds = {(r["kind"], r["a"], r["b"]): r["weight"] for r in edges.collect()}
    assert kinds["spine", "beat 1", "beat 2"] == kinds["recurring", "beat 1", "beat 2"] == 1 and kinds["call", "beat 1", "Read"] == 2 and len(kinds) == 9
    text = graph.report(nodes, edges, False)
    assert text.startswith("8 nodes — 2 beats · 3 tools · 3 targets\n") and "tool ×3  Read" in text
    cut = graph.graph_lines(spark, str(path), len("\n".join(lines[5:])) + 20)
    assert cut.where("truncated").count() == cut.count() > 0 and cut.where("label IS NOT NULL").count() == 1
    first = graph.graph_lines(spark, str(path), 3)  # no line begins so near the end: what holds the first lines is read
    assert first.where("truncated").count() == 0 and [r["tool"] for r in first.collect()] == ["Early"]
    e = Engine(spark, None, None, None)
    assert e.call("session_graph", {"path": str(path)}).count() == 8 and e.call("session_graph", {"path": str(path), "kind": "edges"}).count() == 9


def test_lines_of_split_files(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("\n".join(line("user", f"text {k} " + "x" * (k % 50)) if k % 7 else "" for k in range(3000)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = transcripts.parse_sessions(spark, str(path)).orderBy("seq").collect()
        assert [int(r["text"].split(" ")[1]) for r in rows] == [k for k in range(3000) if k % 7] and [r["seq"] for r in rows] == list(range(len(rows)))
        from logloom.sources.lines import located_lines, parsed_lines

        raw = path.read_bytes()
        assert all(raw[r["seq"] : r["seq"] + 1] in (b"{", b"\n") for r in located_lines(spark, str(path)).collect())
        assert [r["pos"] for r in parsed_lines(spark, str(path)).where("last").collect()] == [2999]
    finally:
        spark.conf.set(key, before)


def test_ranges_of_a_tailed_file(tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [f"line {k} " + "y" * (k % 40) for k in range(500)]
    path.write_text("\n".join(lines) + "\npartial")
    end = tail.complete(str(path), 16)
    assert end == len("\n".join(lines)) + 1
    for step in (7, 64, 10_000):
        got = [x for a in range(0, end, step) for x in tail.lines_between(str(path), a, min(a + step, end))]
        assert [x[1] for x in got] == lines
    reader = tail.TailReader({"path": str(tmp_path / "*.jsonl"), "rangebytes": "1000"})
    latest = reader.latestOffset()
    parts = reader.partitions({}, latest)
    assert len(parts) > 5 and sum(len(list(reader.read(p))) for p in parts) == 500
    path.write_text("new\n")
    again = reader.partitions(latest, reader.latestOffset())
    assert [list(reader.read(p)) for p in again] == [[(str(path), 0, "new", True)]]
    path.unlink()
    assert list(reader.read(again[0])) == []


def test_live_model(spark, root, tmp_path):
    now = 2_000_000_000
    found = transcripts.discover_files(spark, str(root)).withColumn("file_mtime", F.lit(now - 10))
    none = found.where("false").select("file_path", "file_mtime", "file_size", *(F.lit(None).cast("string").alias(c) for c in ("session_uuid", "cwd", "nickname", "agent_role", "parent_uuid", "file_tier")))
    names = spark.createDataFrame([("proj2", "/home/two")], "dir_name string, cwd string")
    one = live.fleet(found.where("session_uuid = 'u1'"), none, names, now, 300)
    two = live.fleet(found, none, names, now, 300)
    assert {r["project"] for r in two.collect()} == {"proj a+b", "/home/two"} and {r["heat"] for r in two.collect()} == {"hot"}
    known = spark.createDataFrame([], schemas.SESSIONS)
    model = live.LiveModel(spark, keep=3)
    events = lambda *kinds: spark.createDataFrame([("p", k, t, None, None, f"x{k}", None) for k, t in enumerate(kinds)], "path string, offset long, line_type string, ts string, role string, text string, summary string")
    first = model.tick(one, known, now, 300, events("user", "mode", "mode"))
    assert first["sessions"].count() == 2 and first["arrived"].count() == 0 and first["status"] == "2 live" and {r["state"] for r in first["sessions"].collect()} == {"new"}
    assert [(r["is_state"], r["count"]) for r in first["folded"].orderBy("first_id").collect()] == [(False, 1), (True, 2)]
    second = model.tick(two, known, now + 2, 300, events("user", "user"))
    assert second["arrived"].count() == 1 and second["entered"].count() == 1 and model.events.count() == 3 and model.last_id == 5
    assert not any(isinstance(v, (list, dict, set)) for v in vars(model).values())  # no rows are held by the driver
    third = model.tick(one, known, now + 4, 600)
    assert third["arrived"].count() == 0 and third["left"].count() == 1 and third["groups"].count() == 1
    kinds = [json.loads(f.first()["frame"])["kind"] for f in live.wire_frames(two, events("user"), "p", events("mode"), ["bad"])]
    assert kinds == ["fleet", "events", "attached", "history", "error"]


def test_command_line(spark, root, tmp_path):
    run = lambda *args: cli.run(spark, cli.parser().parse_args([args[0], "--index", str(tmp_path / "index"), *args[1:]]))
    assert run("diff", "--root", str(root))[:2] == [f"scanned   3 files under {root}", "new       3  (0 MB)"]
    assert json.loads(run("import", "--root", str(root))[0])["files_new"] == 3
    assert run("list", "--sort", "project", "--dir", "asc")[-1] == "3 rows · sort project · tier all · limit 40"
    assert "hello there my world" in "\n".join(run("list"))
    assert "u1" in "\n".join(run("search", "--query", "world")) and "world" in "\n".join(run("searches"))
    assert json.loads(run("embed")[0])["events"] == 3 and json.loads(run("rollouts", "--root", str(root))[0])["files_scanned"] == 0
    for verb, *args in (("status",), ("runs",), ("scan", "--root", str(root)), ("live", "--root", str(root), "--window", "100000"), ("tools",), ("graph", "--path", str(root / "proj2/u2.jsonl")), ("sync", "--roots", json.dumps({"a": str(root)}))):
        assert run(verb, *args), verb
    (tmp_path / "q.jsonl").write_text('// c\n{"query":"words"}\n')
    assert "substring" in "\n".join(run("eval", "--path", str(tmp_path / "q.jsonl")))
    followed = run("tail", "--path", str(root / "proj2/*.jsonl"), "--checkpoint", str(tmp_path / "ck"), "--start", "begin")
    assert len(followed) == 3 and followed[-1].startswith("lines 1 · bytes ")
    assert cli.main(["list", "--index", str(tmp_path / "index"), "--sort", "nope"]) == 2
