"""Names, sizes, blocks, excerpts, arrivals: cases whose answers are fixed."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import blocks
from logloom.functions import scalar as S
from logloom.operators import evaluate, sequence, sessions, topics, vectors
from logloom.sources import transcripts
from logloom.streaming import live


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_agent_names(spark):
    cases = {
        "agent-acodex-freeze-f0999ee5173fe31d": "codex-freeze", "aomx-hermes-addon-2594fe35f9890054": "omx-hermes-addon", "atimestamp-miner-2-1ad4e7b3a36d1cc3": "timestamp-miner-2",
        "adeadbeef-f0999ee5173fe31d": "deadbeef", "a🙂-f0999ee5173fe31d": "🙂", "a57242de08014761b": None, "agent-a57242de08014761b": None, "": None, "a": None, "agent-": None, "agent-a": None,
        "a-": None, "banana": None, "codex-freeze-f0999ee5173fe31d": None, "a1234567890abcde": None, "acodex-freeze-nothexatall": None, "aNAME-F0999EE5173FE31D": None, None: None,
        "a" * 10_000: None, "a" + "f" * 64: None,
    }
    assert apply(spark, S.agent_display_name, list(cases)) == list(cases.values())
    uuid = F.lit("cafd5a9d-e3db-492a-a8fd-56db4fb438fa")
    assert apply(spark, lambda a: S.display_label(uuid, a), ["a0dba268cf1507085", "acat-artist-5a897953c7b59c51", None]) == ["a0dba268cf", "cat-artist", "cafd5a9d"]
    assert apply(spark, lambda a: S.session_label(uuid, a), ["x1", None]) == ["cafd5a9d · x1", "cafd5a9d"]


def test_sizes_and_times(spark):
    assert apply(spark, S.live_size, [0, 999, 1000, 1999, 999_999, 1_000_000, 2_560_000_000], "long") == ["0 B", "999 B", "1 KB", "1 KB", "999 KB", "1.0 MB", "2560.0 MB"]
    assert apply(spark, S.live_ago, [-3, 4, 59, 60, 67, 201, 90_000], "long") == ["0s", "4s", "59s", "1m 00s", "1m 07s", "3m 21s", "1500m 00s"]
    assert apply(spark, S.window_label, [300, 3600, 86_400], "long") == ["5 min", "1 hour", "24 hours"]
    assert apply(spark, S.human_bytes, [5, 40_000_000], "long") == ["5 B", "40.0 MB"]
    assert apply(spark, S.short_time, ["2026-08-24T21:56:55.123Z", "2026", None]) == ["21:56:55", "—", "—"]
    assert apply(spark, S.compact_stamp, ["2026-08-24T21:56:55Z", "x"]) == ["08-24 21:56", "—"]
    assert apply(spark, S.utc_stamp, [0, 86_400], "long") == ["—", "1970-01-02 00:00:00"]
    assert apply(spark, S.iso_stamp, [0], "long") == ["1970-01-01T00:00:00Z"]


def test_topic_names(spark):
    names = {"Hello, World!": "hello_world", "  --": None, "": None, "9 lives": "t_9_lives", "x" * 48: "x" * 48, "x" * 49: None, "หลักฐาน ok": None}
    got = apply(spark, S.sanitize_name, list(names))
    assert got[:-1] == list(names.values())[:-1]


def test_excerpts(spark):
    texts = ["one\ntwo", "", "\n".join(map(str, range(14))), "\n".join(map(str, range(15))), "x" * 7200, "\n".join(["z" * 400] * 80)]
    rows = apply(spark, S.excerpt, texts)
    assert [r["hidden"] for r in rows] == [0, 0, 0, 1, 0, 78] and len(rows[4]["shown"]) == 900
    for text, r in zip(texts, rows):
        assert len(r["shown"].split("\n")) + r["hidden"] == len(text.split("\n")) and text.startswith(r["shown"])


def test_rendering(spark):
    out = apply(spark, lambda t: S.rendered(F.lit(3), F.lit("user"), F.lit("2026-08-24T21:56:55.123Z"), t, 4), ["abcdef", "ab"])
    assert out == ["#3 user 2026-08-24T21:56:55\nabcd\n  […2 more chars]\n\n", "#3 user 2026-08-24T21:56:55\nab\n\n"]
    assert apply(spark, lambda t: S.one_line(t, 6), ["a\nb", "abcdefgh"]) == ["a⏎ b", "abcdef…"]
    path = lambda t: S.short_path(F.lit("-opt-my-repo"), t, F.lit("0123456789"), F.lit("abcdefghijkl"), F.lit("wf_1"))
    assert apply(spark, path, ["session", "subagent", "workflow_agent"]) == ["my-repo/01234567", "my-repo/01234567/abcdefghij", "my-repo/wf_1/abcdefghij"]


def assistant(*content):
    return json.dumps({"type": "assistant", "message": {"content": list(content)}})


def use(name, **tool_input):
    return {"type": "tool_use", "name": name, "input": tool_input}


def test_blocks(spark):
    lines = [
        assistant(use("Bash", command="ls -la\nrm x", description="list")), assistant(use("Edit", file_path="/a", old_string="b")), assistant({"type": "tool_use", "input": {}}),
        assistant(use("T", command="", prompt="go")), assistant({"type": "tool_result", "is_error": True}, {"type": "thinking", "thinking": ""}, {"type": "thinking", "thinking": "\n" + "t" * 70}),
        assistant({"type": "text", "text": "x"}), json.dumps({"type": "user", "message": {"content": "plain"}}), assistant(use("Grep", pattern="p" * 80, path="/p")), assistant(use("N", query=7)),
    ]
    got = apply(spark, lambda v: blocks.summarize(blocks.block_array(F.try_parse_json(v))), lines)
    assert got == [
        "Bash · ls -la", "Edit · /a", "tool", "T · go", "→ error   thinking…   thinking… " + "t" * 64 + "…", None, None, "Grep · " + "p" * 72 + "…", "N",
    ]


def test_details(spark):
    lines = [
        assistant(use("Bash", command="ls /", n=[1, {"a": None}]), {"type": "tool_result", "content": [{"text": "a"}, {"text": "b"}]}, {"type": "tool_result", "is_error": True, "content": "no"},
                  {"type": "tool_result"}, {"type": "thinking"}, {"type": "text", "text": ""}, {"type": "text", "text": "y" * 5500}),
        json.dumps({"type": "user", "message": {"content": "whole"}}), "{broken", json.dumps({"type": "mode"}),
    ]
    rows = [[tuple(x) for x in r] for r in apply(spark, blocks.details, lines)]
    assert rows[0][0] == ("Bash", '{\n  "command" : "ls \\/",\n  "n" : [\n    1,\n    {\n      "a" : null\n    }\n  ]\n}', False)
    assert rows[0][1:5] == [("result", "a\nb", False), ("error", "no", True), ("result", "(empty result)", False), ("thinking", "(reasoning not retained in this transcript)", False)]
    assert rows[0][5] == ("text", "y" * 4000 + "\n… +1,500 more characters (truncated for display)", False) and len(rows[0]) == 6
    assert rows[1:] == [[("user", "whole", False)], [], []]


@pytest.mark.parametrize(
    "line,program",
    [("cd /opt/foo && rg pattern src/", "rg"), ("cd /a/b\nswift build", "swift"), ("/usr/bin/sqlite3 x.db", "sqlite3"), ("sudo launchctl list", "launchctl"), ("FOO=1 BAR=2 python3 x", "python3"),
     ("source x && ls", "source"), ("builtin echo hi", "echo"), ("   ", None), ("> out cat", "out"), ("$X $Y make", "make"), ("a" * 40, "a" * 32), ("(cd /x; ls)", "(cd")],
)
def test_programs(line, program):
    assert blocks.shell_program_of(line) == program


def test_graph_targets(spark):
    lines = [json.dumps(x) for x in ({"path": "", "url": "u"}, {"command": "cd /x && make all"}, {"command": "FOO=1", "pattern": "p" * 60}, {"query": "q"}, {"command": "", "query": ""}, {})]
    assert apply(spark, lambda v: blocks.graph_target(F.try_parse_json(v)), lines) == ["u", "$ make", "p" * 48, "q", None, None]


def test_rollout_texts(spark):
    item = lambda **p: json.dumps({"type": "response_item", "payload": p})
    lines = [
        item(type="message", content=[{"type": "x", "text": "a"}, {"text": ""}, {"text": "b"}]), item(type="custom_tool_call", input=[{"text": "in"}], arguments="!"), item(type="function_call", name="sh"),
        item(type="function_call_output", output=[{"text": "o"}]), item(type="other_call", name="no"), json.dumps({"type": "event_msg", "payload": {"type": "message", "content": "no"}}),
        item(type="message", role="user", content=""), item(type="function_call_output", output=5),
    ]
    got = [r and tuple(r) for r in apply(spark, lambda v: transcripts.rollout_text(F.try_parse_json(v)), lines)]
    assert got == [("assistant", "a\nb"), ("tool_use", "tool · in!"), ("tool_use", "sh"), ("tool_result", "o"), None, None, None, None]


def test_arrivals(spark):
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    before = lambda **p: spark.createDataFrame([(k, float(v)) for k, v in p.items()], "file_path string, arrived_at double")
    seen = lambda *a, **k: {r[0]: r[1] for r in live.track_arrivals(*a, **k).collect()}
    assert seen(files("a", "b", "c"), files(), before(), 100, suppress=True) == {}
    assert seen(files("a", "b"), files("a"), before(), 100) == {"b": 100.0}
    assert seen(files("a"), files("a"), before(a=100), 103) == {"a": 100.0}
    assert seen(files("a"), files("a"), before(a=100), 106.1) == {}
    assert seen(files(), files("a"), before(a=100), 101) == {}


def test_groups(spark):
    rows = [("u1", "/p1", "session", None, 100, 5), ("u1", "/c2", "subagent", "b", 190, 1), ("u1", "/c1", "subagent", "a", 10, 2), ("u0", "/p0", "session", None, 10, 1)]
    out = sessions.group_live(spark.createDataFrame(rows, "session_uuid string, file_path string, file_tier string, agent_id string, file_mtime long, file_size long"), 200).collect()
    assert [(r["session_uuid"], r["parent_path"], r["children"], r["newest"], r["bytes"], r["heat"]) for r in out] == [
        ("u1", "/p1", ["/c1", "/c2"], 190, 8, "hot"), ("u0", "/p0", [], 10, 1, "cool"),
    ]


def test_chunks_without_a_cap(spark):
    events = spark.createDataFrame([(1, 0, " ".join(f"w{k}" for k in range(500)))], "session_id long, seq long, text string")
    assert sequence.chunks(events, 10, 5, 0).count() == 99 and sequence.chunks(events, 10, 5, 4).count() == 4


def test_answers_of_outside_tools(spark):
    rows = [{"text": "a\nb", "type": "note"}, {"title": "t"}, {"x": 1}]
    assert topics.hits_of_text(json.dumps({"memories": rows})) == ["[note] a b", "t", '{"x": 1}']
    assert topics.hits_of_text(json.dumps(rows), 1) == ["[note] a b"]
    assert topics.hits_of_text("short\n" + "l" * 31) == ["l" * 31] and topics.hits_of_text('{"hits": []}') == []
    assert topics.hits_frame(spark, "l" * 400, "up").first()["snippet"] == "l" * 300


def test_failing_sources_take_no_other_along(spark):
    good = lambda: topics.hits_frame(spark, "x" * 40, "one")
    bad = lambda: good().withColumn("snippet", F.raise_error(F.lit("broken")))
    write = lambda hits: spark.createDataFrame(hits.collect(), hits.schema)
    hits, errors = topics.trace("t", {"a": bad, "b": good}, "now", write)
    assert [r["source"] for r in hits.collect()] == ["b"] and "broken" in errors["a"]
    assert topics.trace("t", {"a": bad}, "now", write)[0] is None


def test_vectors_packed_and_plain(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype("f4")
    v[3] = v[4] = v[5]
    rows = [(k, 0, f"text {k % 20}", [float(x) for x in v[k]]) for k in range(60)] + [(98, 0, "short", [1.0]), (99, 0, "none", None)]
    plain = spark.createDataFrame(rows, "session_id long, seq long, text string, vector array<float>").repartition(5)
    packed = plain.where("size(vector) = 8").withColumn("vector", vectors.pack("vector"))
    assert packed.select(vectors.unpack("vector").alias("v")).where("size(v) = 8").count() == 60
    asked = spark.createDataFrame([(0, [float(x) for x in v[7]]), (1, [float(x) for x in v[3]])], "query_id int, vector array<double>")
    whole = plain.where("size(vector) = 8")
    c = v.astype(float) - v.astype(float).mean(0)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for frame in (whole, packed):
        got = {(r["query_id"], r["session_id"]): r["score"] for r in vectors.semantic_scores(frame, asked).collect()}
        assert len(got) == 120 and all(abs(got[q, k] - c[k] @ c[s]) < 1e-9 for q, s in ((0, 7), (1, 3)) for k in range(60))
        full = sequence.keep_best(vectors.semantic_scores(frame, asked.where("query_id = 0")), "text", "score", "session_id").orderBy(F.col("score").desc(), "session_id").limit(5)
        few = vectors.semantic_scores(frame, asked.where("query_id = 0"), best=5)
        best = sequence.keep_best(few, "text", "score", "session_id").orderBy(F.col("score").desc(), "session_id").limit(5)
        assert [r["session_id"] for r in best.collect()] == [r["session_id"] for r in full.collect()] and few.count() < 60
    assert vectors.semantic_scores(plain, asked).count() == 120  # other dimensions are left out
    assert vectors.semantic_scores(plain, asked.where("query_id > 5")).count() == 0


def test_harness(spark):
    texts = [(1, 0, "user", "append only log of events"), (2, 0, "user", "a log that only grows"), (3, 0, "user", "nothing alike here at all"), (4, 0, "user", "another log about cats and dogs")]
    events = spark.createDataFrame(texts, "session_id long, seq long, role string, text string")
    made = vectors.build_embeddings(events.where("session_id < 4"), spark.createDataFrame([], "session_id long, seq long, model string"), ["hash/en/r1/64"], least=1)
    stored = spark.createDataFrame(made.collect(), made.schema)
    asked = spark.createDataFrame([(0, "log", "substring", None, None), (1, "cats", "labeled", None, ["4:0"])], "query_id int, query string, mode string, expect string, ids array<string>")
    embed = lambda text: ("hash/en/r1/64", [float(x) for x in vectors.hashing_provider([text])[0]])
    rows = {r["query_id"]: r for r in evaluate.harness(asked, events, stored, embed).collect()}
    assert (rows[0]["n_truth"], rows[0]["n_embedded"], rows[0]["kw_recall_10"], rows[0]["no_coverage"]) == (3, 2, 1.0, False)
    assert (rows[1]["n_truth"], rows[1]["n_embedded"], rows[1]["kw_rr"], rows[1]["no_coverage"]) == (1, 0, 1.0, True)
    assert evaluate.mode_means(evaluate.harness(asked, events, stored, embed)).count() == 2
    terms = spark.createDataFrame([(0, "log")], "position long, term string")
    assert evaluate.written_queries(terms, ['{"mode":"labeled"}', "// no"])[1:] == ["// labelled by hand", '{"mode":"labeled"}']
