"""Frames by listener: places kept, replays that send nothing twice, batches dropped once all have read them."""

import json

import pytest

from logloom.streaming import live
from logloom.streaming.frames import FrameSink

from .test_transcripts import line


def rows(spark, *texts, path="p"):
    return spark.createDataFrame([(path, k, t) for k, t in enumerate(texts)], "path string, offset long, text string")


def texts(frames):
    return [json.loads(f)["data"]["text"] for f in frames]


def test_each_listener_reads_every_frame_once(spark, tmp_path):
    sink = FrameSink(spark, str(tmp_path / "sink"))
    sink.attach("early")
    assert sink.poll("early") == [] and sink.prune() == 0
    sink(rows(spark, "a", "b"), 0)
    sink(rows(spark, "c", "d", "e"), 1)
    assert texts(sink.poll("early", 3)) == ["a", "b", "c"] and texts(FrameSink(spark, str(tmp_path / "sink")).poll("early")) == ["d", "e"]
    # a restarted query hands its last batch over again
    sink(rows(spark, "c", "d", "e"), 1)
    assert sink.poll("early") == [] and sink.batches() == [0, 1]
    sink.attach("late")
    sink.attach("back", history=1)
    sink(rows(spark, "f"), 2)
    assert texts(sink.poll("late")) == ["f"] and texts(sink.poll("back")) == ["c", "d", "e", "f"] and texts(sink.poll("early")) == ["f"]
    sink.attach("late")  # a known listener stays where it was
    assert sink.poll("late") == []
    assert json.loads(spark.read.parquet(str(tmp_path / "sink/frames/batch=2")).first()["frame"])["kind"] == "events"
    assert sink.prune() == 2 and sink.batches() == [2]
    sink(rows(spark, "g"), 3)
    sink(rows(spark), 4)
    assert texts(sink.poll("early")) == ["g"] and sink.prune() == 0
    sink.detach("late")
    sink.detach("back")
    assert sink.prune() == 1 and sink.poll("early") == []
    for name in ("", "../x", "a/b"):
        with pytest.raises(ValueError):
            sink.attach(name)
    with pytest.raises(ValueError):
        sink.poll("late")


def test_a_followed_file_reaches_its_listeners(spark, tmp_path):
    folder, sink = tmp_path / "logs", FrameSink(spark, str(tmp_path / "sink"))
    folder.mkdir()
    sink.attach("one")
    for k in range(2):
        with (folder / "a.jsonl").open("a") as f:
            f.write(line("user", f"text {k}") + "\n")
        q = live.watch(live.to_events(live.tail(spark, str(folder / "*.jsonl"), start="begin")), str(tmp_path / "ck"), sink, once=True)
        assert q.awaitTermination(60)
        assert texts(sink.poll("one")) == [f"text {k}"]
