"""Bounded reads, lines of split files, and roots with odd names."""

import json

import pytest

from logloom.operators import graph
from logloom.sources import ranges, transcripts
from logloom.sources.lines import located_lines, parsed_lines

from .test_transcripts import line


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A file of 100 MB, its first lines short and its last ones known."""
    path = tmp_path_factory.mktemp("large dir+x") / "s é.jsonl"
    filler = (line("assistant", "f" * 1000) + "\n").encode()
    with path.open("wb") as f:
        f.write(b"\n" + line("user", "begin", "t0", cwd="/home/x").encode() + b"\n")
        f.write(filler * ((100 << 20) // len(filler)))
        f.write("".join(line("user", f"end {k}") + "\n" for k in range(20)).encode() + b'{"type":"user"')
    return path


def test_what_is_read_of_a_large_file_is_bounded(spark, large):
    files = ranges.listed(spark, str(large))
    assert files.first()["file_size"] > 100 << 20
    heads = ranges.heads(files, 64 << 10, 4).collect()
    assert len(heads) == 4 and sum(r["n_read"] for r in heads) == 64 << 10 and heads[0]["raw"].startswith('{"')
    tails = ranges.tails(files, 8 << 20).selectExpr("count(*) n", "sum(n_read) r", "min(offset) a", "max(offset) b", "bool_and(truncated) t").first()
    assert (8 << 20) <= tails["r"] <= (8 << 20) + 1 and tails["t"] and tails["a"] >= files.first()["file_size"] - (8 << 20)
    rows = graph.graph_lines(spark, str(large)).where("label LIKE 'end%'").collect()
    assert len(rows) == 20 and all(r["truncated"] for r in rows)
    assert transcripts.first_cwd(files).first()["cwd"] == "/home/x"
    # located lines agree on places
    last = located_lines(spark, str(large)).selectExpr("max(seq) m").first()["m"]
    assert last == tails["b"]


@pytest.mark.parametrize("most", [1, 3, 7, 12, 20, 64])
def test_last_lines_against_the_whole(tmp_path, most):
    for data in (b"", b"abc", b"ab\n", b"\n\n", b"one\ntwo\nthree\n", b"one\ntwo\npart", b"a long first line\nx\n", b"x\na long last line without an end" * 2):
        path = tmp_path / "f"
        path.write_bytes(data)
        whole, at = [], 0
        for raw in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]:
            whole.append((at, raw))
            at += len(raw) + 1
        found, size, truncated, _ = ranges.last_lines(str(path), most, 1 << 20)
        near = [x for x in whole if x[0] >= len(data) - most]
        begins = [a for a in [0, *(k + 1 for k, c in enumerate(data) if c == 10)] if len(data) - most <= a < len(data)]
        if len(data) <= most:
            assert found == whole and not truncated
        elif begins:
            assert found == near and truncated == (begins[0] > 0)
        else:  # from the beginning, and as far as one line at least
            assert found == whole[: len(found)] and not truncated and (found or not whole)
        assert size == len(data)


def test_vanished_and_empty_files(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    frame = spark.createDataFrame([(f"file:{tmp_path}/empty",), (str(tmp_path / "gone"),)], "file_path string")
    assert ranges.heads(frame, 10, 3).count() == ranges.tails(frame, 10).count() == 0
    assert ranges.reachable("/a") and ranges.reachable("hdfs://n/x") and not ranges.reachable("viewfs://n/x")
    with pytest.raises(ValueError):
        ranges.open_input("viewfs://n/x")


def test_a_huge_file_is_numbered_by_its_splits(spark, tmp_path):
    path, other = tmp_path / "long.jsonl", tmp_path / "short.jsonl"
    lines = [line("user", f"text {k} é" + "x" * (k % 50)) if k % 7 else " " * (k % 3) for k in range(4000)]
    path.write_text("\n".join(lines))
    other.write_text(line("user", "alone") + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "9000")
    try:
        parsed = parsed_lines(spark, [str(path), str(other)])
        rows = parsed.where("file_path LIKE '%long%'").orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(4000)) and [r["raw"] for r in rows] == lines
        full = [r["line"] for r in rows if r["raw"].strip()]
        assert full == list(range(len(full))) and [r["pos"] for r in rows if r["last"]] == [3999]
        assert len({r["block"] for r in rows}) > 20
        assert [(r["pos"], r["last"]) for r in parsed.where("file_path LIKE '%short%'").collect()] == [(0, False)]
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.split("\n") if "windowspecdefinition(file_path" in x and "windowspecdefinition(file_path#" in x and "block" not in x.split("windowspecdefinition")[1].split(",")[1]]
        assert all("raw" not in x for x in windows)  # windows by file see totals of splits alone
        data = path.read_bytes()
        located = located_lines(spark, str(path)).orderBy("seq").collect()
        starts = [0, *(k + 1 for k, c in enumerate(data) if c == 10)]
        assert [r["seq"] for r in located] == starts[:-1]
        told = transcripts.parse_sessions(spark, str(path)).orderBy("seq").collect()
        assert [int(r["text"].split(" ")[1]) for r in told] == [k for k in range(4000) if k % 7]
        meta = json.dumps({"type": "session_meta", "payload": {"id": "u"}})
        item = lambda k: json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", "content": f"t{k}"}})
        path.write_text("\n".join([meta] + [item(k) if k % 3 else '{"type":"event"}' for k in range(3000)]) + "\n")
        rolled = transcripts.parse_rollouts(spark, str(path)).where("seq IS NOT NULL").orderBy("pos").collect()
        assert [r["seq"] for r in rolled] == list(range(2000)) and [r["text"] for r in rolled] == [f"t{k}" for k in range(3000) if k % 3]
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["projects", "c++", "a.b[x", "x projects", "ü (1)"])
def test_files_are_found_below_roots_of_any_name(spark, tmp_path, name):
    for base in (tmp_path / name, tmp_path / name / "sub" / name):
        (base / "p").mkdir(parents=True)
        (base / "p/u1.jsonl").write_text(line("user", "x") + "\n")
        found = transcripts.discover_files(spark, str(base) + "/").where("file_path LIKE '%/p/u1.jsonl'").collect() if "[" not in name else None
        if found is not None:
            mine = [r for r in found if r["dir_name"] == "p" and r["file_tier"] == "session"]
            assert len(mine) == 1 and mine[0]["session_uuid"] == "u1"


def test_headers_come_from_the_first_bytes(spark, tmp_path):
    meta = json.dumps({"type": "session_meta", "payload": {"id": "own", "cwd": "/w", "thread_source": "subagent"}})
    uuid = "11111111-2222-3333-4444-555555555555"
    (tmp_path / f"rollout-2026-01-01T00-00-00-{uuid}.jsonl").write_text("\n" + "x\n" + meta + "\n" + "y" * 500_000 + "\n")
    late = tmp_path / "rollout-2026-01-01T00-00-00-aaaaaaaa-2222-3333-4444-555555555555.jsonl"
    late.write_text("x\n" * 9 + meta + "\n")
    heads = {r["file_path"].rsplit("/", 1)[1][28:32]: r for r in transcripts.probe_headers(transcripts.rollout_files(spark, str(tmp_path))).collect()}
    assert (heads["1111"]["session_uuid"], heads["1111"]["cwd"], heads["1111"]["file_tier"]) == ("own", "/w", "subagent")
    assert (heads["aaaa"]["session_uuid"], heads["aaaa"]["cwd"]) == ("aaaaaaaa-2222-3333-4444-555555555555", None)
