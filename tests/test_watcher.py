"""Following files: shares of a trigger, windows of recency, files that come, go and shrink, and what is counted."""

import json
import os
import threading
import time

from logloom import __main__ as cli
from logloom.sources import tail
from logloom.streaming import live

from .test_transcripts import line


def reader(tmp_path, now=None, **options):
    own = {"path": str(tmp_path / "*.jsonl"), "rescanSeconds": "0", **{k: str(v) for k, v in options.items()}}
    return tail.TailReader(own, (lambda: now[0]) if now else time.time)


def rows(r, start, end):
    return [(os.path.basename(p), at, text) for part in r.partitions(start, end) for p, at, text, _ in r.read(part)]


def test_a_backlog_of_a_gigabyte_holds_nothing_up(tmp_path):
    big, small = tmp_path / "big.jsonl", [tmp_path / f"s{k}.jsonl" for k in range(3)]
    filler = ("x" * 1023 + "\n").encode() * 1024
    with big.open("wb") as f:
        for _ in range(1024):
            f.write(filler)
    r = reader(tmp_path, start="begin", maxBytesPerTrigger=8 << 20, rangeBytes=1 << 20)
    at = r.initialOffset()
    for tick in range(4):
        for s in small:
            with s.open("a") as f:
                f.write(f"tick {tick}\n")
        end = r.latestOffset()
        assert r.latestOffset() == end  # asking again plans nothing
        parts = r.partitions(at, end)
        assert sum(p.stop - p.start for p in parts) <= 8 << 20
        assert [x[2] for p in parts if "big" not in p.path for x in (t for t in r.read(p))] == [f"tick {tick}"] * 3
        moved = end[str(big)] - at.get(str(big), 0)
        assert 7 << 20 < moved <= 8 << 20 and end[str(big)] % 1024 == 0
        at = end
    assert r.held_back() == (1 << 30) - at[str(big)]


def test_files_enter_leave_shrink_and_vanish(tmp_path):
    now = [10_000.0]
    old, new = tmp_path / "old.jsonl", tmp_path / "new.jsonl"
    old.write_text("there before\nand\n")
    os.utime(old, (1000, 1000))
    r = reader(tmp_path, now, windowSeconds=60)
    at = r.initialOffset()
    assert at == {str(old): 17}  # from the end, unless told otherwise
    new.write_text("first\npart")
    os.utime(new, (now[0], now[0]))
    end = r.latestOffset()
    assert rows(r, at, end) == [("new.jsonl", 0, "first")]  # a file that comes is read whole; a part of a line waits
    at = end
    with old.open("a") as f:
        f.write("not yet\n")
    os.utime(old, (1000, 1000))  # outside of the window: left alone, but its place is kept
    assert r.latestOffset()[str(old)] == 17
    os.utime(old, (now[0], now[0]))
    with new.open("a") as f:
        f.write("ial\n")
    os.utime(new, (now[0], now[0]))
    end = r.latestOffset()
    assert sorted(rows(r, at, end)) == [("new.jsonl", 6, "partial"), ("old.jsonl", 17, "not yet")]
    at = end
    new.write_text("anew\n")
    os.utime(new, (now[0], now[0]))
    end = r.latestOffset()
    assert [x[1:] for x in ((p.path, p.start, p.truncated) for p in r.partitions(at, end))] == [(0, True)] and rows(r, at, end) == [("new.jsonl", 0, "anew")]
    old.unlink()
    assert set(r.latestOffset()) == {str(new)}


def test_the_glob_is_looked_through_now_and_then(tmp_path):
    now = [0.0]
    r = reader(tmp_path, now, rescanSeconds=10)
    assert r.initialOffset() == {}
    (tmp_path / "a.jsonl").write_text("x\n")
    assert r.latestOffset() == {}
    r.partitions({}, {})
    now[0] = 11.0
    assert r.latestOffset() == {str(tmp_path / "a.jsonl"): 2}


def test_within_stops_at_newlines(tmp_path):
    path = tmp_path / "f"
    data = b"ab\ncdefgh\n\nlong line of some length\nrest"
    path.write_bytes(data)
    ends = [k + 1 for k, c in enumerate(data) if c == 10]
    for at in [0, *ends]:
        for most in range(1, 45):
            before = [e for e in ends if at < e <= at + most]
            after = [e for e in ends if e > at]
            assert tail.within(str(path), at, most, 4) == (max(before) if before else min(after, default=at))


def test_a_query_goes_on_within_its_bounds(spark, tmp_path):
    folder, checkpoint = tmp_path / "logs", str(tmp_path / "checkpoint")
    folder.mkdir()
    path = folder / "a.jsonl"
    path.write_text("".join(line("user", f"row {k}") + "\n" for k in range(200)))
    size, got = path.stat().st_size, []
    options = {"start": "begin", "maxBytesPerTrigger": str(size // 4), "checkpoint": checkpoint}

    def run():
        got.clear()
        q = live.watch(live.counted(live.to_events(live.tail(spark, str(folder / "*.jsonl"), **options))), checkpoint, lambda df, _: got.extend(r["text"] for r in df.orderBy("offset").collect()), once=True)
        assert q.awaitTermination(60)
        counters = live.Counters()
        counters.add(q)
        return list(got), counters.total

    assert tail.committed(checkpoint) == {}
    told = []
    for _ in range(6):  # each start takes a trigger's share and no more
        rows_, total = run()
        assert len(rows_) <= 60 and total["lines"] == len(rows_) and total["malformed"] == 0
        told += rows_
    assert told == [f"row {k}" for k in range(200)] and tail.committed(checkpoint) == {str(path): size}
    with path.open("a") as f:
        f.write("{broken\n" + line("mode") + "\npart")
    rows_, total = run()
    assert (total["lines"], total["malformed"], total["held_back"]) == (2, 1, 4) and total["bytes"] == path.stat().st_size - size - 4


def test_the_verb_tail_follows_for_some_seconds(spark, tmp_path):
    path = tmp_path / "logs/a.jsonl"
    path.parent.mkdir()
    path.write_text(line("user", "there before") + "\n")

    def write():
        until = time.time() + 60
        while not (tmp_path / "ck/offsets/0").exists() and time.time() < until:
            time.sleep(0.2)
        with path.open("a") as f:
            f.write(line("user", "comes later") + "\n" + "no json\n" + '{"half"')

    writer = threading.Thread(target=write)
    writer.start()
    out = cli.run(spark, cli.parser().parse_args(["tail", "--index", str(tmp_path / "i"), "--path", str(path), "--for", "20", "--raw", "--checkpoint", str(tmp_path / "ck")]))
    writer.join()
    assert sum("comes later" in x for x in out) == 1 and not any("there before" in x for x in out) and any(json.dumps("user") in x for x in out)
    assert out[-1].startswith("lines 2 · ") and "malformed 1" in out[-1] and out[-1].endswith("held back 7")
