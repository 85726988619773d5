"""Growing files as a stream: complete lines by byte offset; a partial last line waits for its newline.

The driver looks for files now and then, and at their sizes at every trigger. A trigger takes maxBytesPerTrigger in
all, dealt out evenly among the files that have something new, each up to a newline; the rest waits in the offset. What
lies between two offsets is read by the executors, in ranges of rangeBytes each. A line belongs to the range that it
begins in. The offset has a place for each file that is there, also for those outside of the window of recency: one
that is written again goes on where it was left. A file that comes later is read from its first byte.
"""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from logloom.schemas import TAIL_ROWS

CHUNK, LARGEST = 4 << 20, 64 << 20


def read_lines(path: str, offset: int, cap: int = CHUNK, largest: int = LARGEST) -> tuple[list[tuple[int, str]], int, bool, bool]:
    """(lines with their offsets, next offset, truncated, more). A window without a newline doubles up to
    ``largest``; a file shorter than the offset is read anew."""
    size = os.path.getsize(path)
    truncated = size < offset
    at = 0 if truncated else offset
    with open(path, "rb") as f:
        while True:
            f.seek(at)
            data = f.read(cap)
            end = data.rfind(b"\n") + 1
            if end or len(data) < cap or cap >= largest:
                break
            cap *= 2
    if not end and len(data) >= largest:  # a line beyond all bounds is given out in parts
        end = len(data)
    rows, pos = [], 0
    for line in data[:end].split(b"\n")[: None if end and data[end - 1 : end] != b"\n" else -1]:
        rows.append((at + pos, line.decode("utf-8", "replace")))
        pos += len(line) + 1
    return rows, at + end, truncated, at + end < size and end > 0


def aligned(path: str, offset: int, scan: int = CHUNK) -> int:
    """The next line's begin at or after offset; the file's end if there is none near."""
    size = os.path.getsize(path)
    if offset <= 0 or offset >= size:
        return max(0, min(offset, size))
    with open(path, "rb") as f:
        f.seek(offset - 1)
        data = f.read(scan)
    k = data.find(b"\n")
    return size if k < 0 else offset + k


def complete(path: str, window: int = 64 << 10) -> int:
    """The offset behind the file's last newline; 0 without one. Looks back from the end, a window at a time."""
    stop = os.path.getsize(path)
    with open(path, "rb") as f:
        while stop > 0:
            start = max(0, stop - window)
            f.seek(start)
            k = f.read(stop - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            stop, window = start, window * 2
    return 0


def within(path: str, at: int, most: int, window: int = 64 << 10, largest: int = LARGEST) -> int:
    """The offset behind the last newline among the ``most`` bytes after at; where they have none, behind the next one;
    at where there is none so far (or none in ``largest`` bytes)."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        stop, step = min(size, at + most), window
        while stop > at:
            start = max(at, stop - step)
            f.seek(start)
            k = f.read(stop - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            stop, step = start, step * 2
        start = min(size, at + most)
        f.seek(start)
        while start < min(size, at + largest) and (data := f.read(CHUNK)):
            k = data.find(b"\n")
            if k >= 0:
                return start + k + 1
            start += len(data)
    return at


def committed(checkpoint: str) -> dict[str, int]:
    """The places that a query's checkpoint folder has as done; none without one."""
    numbered = lambda kind: {int(n) for n in os.listdir(f"{checkpoint}/{kind}") if n.isdigit()} if os.path.isdir(f"{checkpoint}/{kind}") else set()
    done = numbered("commits") & numbered("offsets")
    if not done:
        return {}
    with open(f"{checkpoint}/offsets/{max(done)}") as f:
        return {k: int(v) for k, v in json.loads(f.read().strip().split("\n")[-1]).items()}


def lines_between(path: str, start: int, stop: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin at or after start and before stop, the first of them after a newline."""
    with open(path, "rb") as f:
        f.seek(max(0, start - 1))
        if start > 0 and f.read(1) != b"\n":
            f.readline()
        at = f.tell()
        while at < stop:
            line = f.readline()
            if not line.endswith(b"\n"):
                break
            yield at, line[:-1].decode("utf-8", "replace")
            at += len(line)


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, truncated: bool):
        self.path, self.start, self.stop, self.truncated = path, start, stop, truncated


class TailReader(DataSourceStreamReader):
    """options: path (a glob), start (end, begin: where files that are there at first begin), rewindBytes (before the
    end), rangeBytes (of a file that one task reads), maxBytesPerTrigger, windowSeconds (files written so lately are
    followed; 0: all), rescanSeconds (how often the glob is looked through), checkpoint (the query's folder: a query that
    is started again keeps its first trigger within its bounds)."""

    def __init__(self, options: dict[str, str], clock: Callable[[], float] = time.time):
        own = {k.lower(): v for k, v in dict(options).items()}
        self.pattern, self.start = own["path"], own.get("start", "end")
        number = lambda name, default: int(own.get(name.lower(), default))
        self.rewind, self.range = number("rewindBytes", 0), number("rangeBytes", CHUNK)
        self.most, self.window, self.rescan = number("maxBytesPerTrigger", LARGEST), number("windowSeconds", 0), number("rescanSeconds", 10)
        self.checkpoint, self.clock = own.get("checkpoint", "").removeprefix("file://"), clock
        self.first: dict[str, int] | None = None  # where files begin that were there at first
        self.at: dict[str, int] | None = None  # where each file will have been read up to, once what is planned is done
        self.files: list[str] = []
        self.scanned = float("-inf")

    def _scan(self) -> list[str]:
        if self.clock() - self.scanned >= self.rescan:
            self.files, self.scanned = sorted(glob.glob(self.pattern, recursive=True)), self.clock()
        return self.files

    def initialOffset(self) -> dict:
        if self.first is None:
            self.first = {}
            for path in self._scan() if self.start != "begin" else ():
                try:
                    self.first[path] = aligned(path, max(0, os.path.getsize(path) - self.rewind))
                except OSError:  # a file may vanish at any time
                    pass
        return dict(self.first)

    def latestOffset(self) -> dict:
        """May be asked any number of times before what it tells is planned."""
        if self.at is None:
            self.at = (committed(self.checkpoint) if self.checkpoint else {}) or self.initialOffset()
        out: dict[str, int] = {}
        grown: dict[str, int] = {}
        for path in self._scan():
            try:
                found = os.stat(path)
            except OSError:
                continue
            at = self.at.get(path, 0)
            out[path] = at if at <= found.st_size else 0  # replaced by a shorter one: it is read anew
            if found.st_size > out[path] and (not self.window or self.clock() - found.st_mtime <= self.window):
                grown[path] = found.st_size - out[path]
        # those with little left take what they need, the others share the rest
        left = self.most
        for k, (path, size) in enumerate(sorted(grown.items(), key=lambda x: (x[1], x[0]))):
            share = max(1, left // (len(grown) - k))
            try:
                to = within(path, out[path], min(size, share))
            except OSError:
                continue
            left, out[path] = max(0, left - (to - out[path])), to
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        self.at = {p: int(x) for p, x in end.items()}
        for path, stop in sorted(self.at.items()):
            at = int(start.get(path, 0))
            truncated = stop < at
            for a in range(0 if truncated else at, stop, self.range):
                out.append(Range(path, a, min(a + self.range, stop), truncated))
        return out

    def held_back(self) -> int:
        """Bytes behind the last newlines and bytes that wait for a later trigger."""
        return sum(max(0, os.path.getsize(p) - at) for p, at in (self.at or {}).items() if os.path.exists(p))

    def read(self, partition: Range) -> Iterator[tuple]:
        try:
            for offset, line in lines_between(partition.path, partition.start, partition.stop):
                yield partition.path, offset, line, partition.truncated
        except FileNotFoundError:
            return


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); spark.readStream.format("tail").option("path", glob).load()"""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> StructType:
        return TAIL_ROWS

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


def history(path: str, before: int, window: int = 256 << 10) -> tuple[list[tuple[int, str]], bool]:
    """(complete lines in the window before a byte offset, whether it reaches the file's begin)."""
    start = aligned(path, max(0, before - window))
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read(max(0, before - start))
    rows, pos = [], start
    for line in data.split(b"\n")[:-1]:
        rows.append((pos, line.decode("utf-8", "replace")))
        pos += len(line) + 1
    return rows, start == 0
