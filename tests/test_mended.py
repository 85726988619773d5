"""What went wrong once: work lists that never end, ids taken for uuids, limits that starve, counts by the wrong rule."""

import json

import pytest
from pyspark.sql import functions as F

from logloom import __main__ as cli
from logloom import schemas
from logloom.operators import sessions as ops
from logloom.operators import vectors
from logloom.plans.api import Engine, Refused
from logloom.sources.store import Store

from .test_transcripts import line


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("mended")
    root = base / "corpus/p"
    root.mkdir(parents=True)
    (root / "12345678-aaaa.jsonl").write_text(
        "\n".join([*(line("user", f"short {k}") for k in range(45)), line("user", "ข้อความภาษาไทยที่ยาวพอสำหรับการฝังเวกเตอร์"), line("assistant", "an English text, long enough to be embedded")]) + "\n"
    )
    (root / "87654321-bbbb.jsonl").write_text(line("user", "another text that is long enough by far", "2026-01-01T00:00:00Z") + "\n")
    own = Store(spark, str(base / "index"))
    own.init()
    own.import_transcripts(str(base / "corpus"), "2026-01-02 00:00:00", 1)
    return own


def test_nothing_is_embedded_twice_whatever_its_language(store):
    model = "hash/en/r1/64"
    first = store.build_embeddings([model], "t", 1)
    assert first == {"events": 3, "vectors": 3, "skipped": 0}
    assert {r["model"] for r in store.read("event_vectors").collect()} == {model, "hash/th/r1/64"}
    assert store.build_embeddings([model], "t", 2)["events"] == 0 and store.build_embeddings(["hash/th/r1/64"], "t", 3)["events"] == 0
    assert vectors.family([model]) == [model, "hash/th/r1/64", "hash/zh-Hans/r1/64", "hash/ja/r1/64"] and vectors.family(["own"]) == ["own"]


def test_the_verb_embed_has_no_limit_of_its_own(spark, store):
    parsed = cli.parser().parse_args(["embed", "--index", store.root])
    assert parsed.limit is None
    assert json.loads(cli.run(spark, cli.parser().parse_args(["embed", "--index", store.root, "--model", "other/en/r1/64"]))[0])["events"] == 3


def test_texts_that_a_provider_refuses_are_counted(spark, store):
    provider = lambda texts, dim=64: [None if "English" in t else v for t, v in zip(texts, vectors.hashing_provider(texts))]
    counts = store.build_embeddings(["third/en/r1/64"], "t", 9, provider)
    assert counts["skipped"] == 1 and store.read("event_vectors").where("vector IS NULL").count() == 0
    many = spark.createDataFrame([(1, 1, "user", None, "word " * 5000)], schemas.EVENTS)
    built = lambda most: vectors.build_embeddings(many, store.read("event_vectors"), ["m"], most=most).count()
    assert (built(32), built(0), built(5)) == (32, 99, 5)


def test_sessions_are_named_by_uuid_or_by_id(spark, store):
    engine = Engine.of(store, roots={"own": store.root.replace("index", "corpus")})
    by_uuid = engine.call("read_session", {"session": "12345678"}).first()
    known = store.read("sessions").where("session_uuid LIKE '1234%'").first()["id"]
    assert by_uuid["session_id"] == known == engine.call("read_session", {"id": known}).first()["session_id"]
    assert engine.call("read_context", {"session": "8765", "seq": 0}).count() == 1
    for args in ({}, {"session": "12345678", "id": 1}, {"session": "99999999"}):
        with pytest.raises(Refused):
            engine.call("read_session", args)


def test_searches_are_logged_and_shown_with_snippets(spark, store):
    engine = Engine.of(store)
    before = store.read("search_log").count()
    hits = engine.call("search_sessions", {"query": "long enough"}).collect()
    assert len(hits) == 2 and all("«long»" in r["snippet"] for r in hits)
    log = store.read("search_log")
    assert log.count() == before + 1 and log.orderBy(F.col("id").desc()).first()["hits"] == 2
    assert any("«long»" in x for x in cli.run(spark, cli.parser().parse_args(["search", "--index", store.root, "--query", "long enough"])))


def test_status_tells_what_is_pending(spark, store, tmp_path):
    root = store.root.replace("index", "corpus")
    (tmp_path / "more/p").mkdir(parents=True)
    (tmp_path / "more/p/u9.jsonl").write_text(line("user", "x") + "\n")
    one = Engine.of(store, roots={"own": root, "more": str(tmp_path / "more")}).call("index_status").first()
    assert (one["sessions"], one["imported"], one["failed"], one["projects"], one["pending_new"], one["pending_changed"]) == (2, 2, 0, 1, 1, 0)
    assert one["events"] == 48 and one["lines"] == 48 and one["last_import"] == "2026-01-02 00:00:00" and one["tiers"][0]["files"] == 2
    with pytest.raises(Refused):
        Engine.of(store).call("list_sessions", {"since": "soon"})
    assert Engine.of(store).call("list_sessions", {"since": "7d"}).count() == 2 and Engine.of(store).call("list_sessions", {"since": "all"}).count() == 2


def test_a_scan_looks_at_stamp_and_size_alone(spark):
    known = spark.createDataFrame([("a", 1, 5, "failed"), ("b", 1, 5, "imported"), ("c", 1, 5, "imported")], "file_path string, file_mtime long, file_size long, import_status string")
    disk = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 1, 6), ("d", 1, 1)], "file_path string, file_mtime long, file_size long")
    assert {r["file_path"]: r["state"] for r in ops.scan_states(known, disk).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new"}
    assert ops.database_age(None) == ("missing", 0) and ops.database_age(known.where("false")) == ("empty", 0) and ops.database_age(known) == ("populated", 3)


def test_tools_are_called_by_the_flags_that_they_declare(spark, store):
    call = lambda *args: cli.run(spark, cli.parse(["call", "--index", store.root, *args]))
    assert len(call("--tool", "search_sessions", "--", "--query", "long enough", "--limit", "1")) == 2
    assert len(call("--tool", "list_sessions", "--", "--sort", "size", "--dir", "asc")) == 3
    assert len(call("--tool", "read_session", "--", "--session", "12345678", "--from", "3", "--limit", "2")) == 3
    for args in (("--tool", "none"), ("--tool", "search_sessions"), ("--tool", "list_sessions", "--", "--sort", "colour"), ("--tool", "index_status", "--", "--more", "1"), ("--tool", "list_sessions", "--", "--limit", "0")):
        with pytest.raises(Refused):
            call(*args)
    shown = cli.run(spark, cli.parser().parse_args(["tools", "--index", store.root]))
    assert shown[0].endswith("built-in  15 tools") and "all       15 tools" in shown[1] and shown[2] == "15 tools: within every known limit"
    from logloom.plans.api import budget_note

    assert [budget_note(n).split(": ")[1][:6] for n in (20, 21, 31, 41)] == ["within", "below ", "at the", "beyond"]
