"""Arrivals and leaves by Spark's state: timers, replays, and the state read back."""

import json
import os

from pyspark.sql import functions as F

from logloom.streaming import live


def test_presence_keeps_its_state_in_spark(spark, tmp_path):
    source, checkpoint, got = tmp_path / "scans", str(tmp_path / "checkpoint"), []
    source.mkdir()
    stamp = lambda s: f"2026-01-01 00:00:{s:02d}"

    def scan(second, *paths):
        path = source / f"{second:02d}.json"
        path.write_text("\n".join(json.dumps({"path": p, "at": stamp(second)}) for p in paths) + "\n")
        os.utime(path, (1_700_000_000 + second, 1_700_000_000 + second))  # files are taken in the order of their times

    def run():
        got.clear()
        files = spark.readStream.schema("path string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        q = live.watch(live.presence(files, "6 seconds", stamp(0)), checkpoint, lambda df, _: got.extend((r["path"], r["kind"], r["at"].second) for r in df.collect()), once=True)
        assert q.awaitTermination(120)
        return sorted(got)

    before = spark.conf.get(live.STATE_STORE[0])
    try:
        scan(0, "a", "b")  # the first scan: nothing arrives
        scan(2, "a", "b", "c")
        scan(4, "a", "c")
        scan(10, "a")
        first = run()
        assert ("c", "arrived", 2) in first and not any(k == "arrived" and p in "ab" for p, k, _ in first)
        scan(30, "a", "b")
        second = first + run()
        scan(50, "z")
        second += run()
        # b and c were not seen for six seconds, nor a after 10; they come again at 30 and leave after that
        assert {("b", "left", 8), ("c", "left", 10), ("a", "left", 16), ("a", "arrived", 30), ("b", "arrived", 30), ("z", "arrived", 50)} <= set(second)
        assert len(second) == len(set(second))
        state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
        rows = {r["path"]: (r["first"], r["last"]) for r in state.select(F.col("key.path").alias("path"), "value.first", "value.last").collect()}
        assert "z" in rows and "c" not in rows and rows["z"][0] == rows["z"][1]
    finally:
        spark.conf.set(live.STATE_STORE[0], before)
