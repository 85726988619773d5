"""Bounded reads: the first lines of many files, or the lines in their last bytes, without reading what lies between.

The files are rows of a DataFrame, so their number is bounded by nothing; each task opens its own and reads one
range of each. Local files, HDFS and object stores are opened by pyarrow; ``reachable`` tells whether a path is one
of those. A file that has vanished gives no row. n_read is what was read of the file, on its first row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line longer than this is given up when the search for a first line's end goes on and on.
LARGEST = 64 << 20
_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _parts(path: str) -> tuple[str, str, str]:
    """(scheme, authority, path): as Hadoop spells them, nothing is encoded."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*|[^/].*)", path, re.DOTALL)
    return (m[1].lower(), m[2] or "", m[3]) if m else ("file", "", path)


def reachable(path: str) -> bool:
    return _parts(path)[0] in _SCHEMES


def open_input(path: str) -> pa.NativeFile:
    from pyarrow import fs

    scheme, authority, rest = _parts(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file(rest)
    if scheme not in _SCHEMES:
        raise ValueError(f"no ranged reads of {scheme}: paths")
    system, base = fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}://{authority}/")
    return system.open_input_file(rest if scheme == "hdfs" else f"{base.rstrip('/') or authority}{rest}")


def first_lines(path: str, most: int, lines: int) -> tuple[list[bytes], int]:
    """(the first lines that aren't empty, the last of them perhaps cut; bytes read) of the first ``most`` bytes."""
    with open_input(path) as f:
        data = f.read(most)
    return [x for x in data.split(b"\n") if x][:lines], len(data)


def last_lines(path: str, most: int, largest: int = LARGEST) -> tuple[list[tuple[int, bytes]], int, bool, int]:
    """(offset and bytes of each complete line that begins in the last ``most`` bytes, size, whether there are lines
    before, bytes read). Where none begins there, those of the first ``most`` bytes, or as many as the first line needs."""
    with open_input(path) as f:
        size = f.size()
        start, n_read, data = max(0, size - most), 0, b""
        if start:
            f.seek(start - 1)
            data = f.read(most + 1)
            n_read += len(data)
            skip = data.find(b"\n") + 1
            start = start - 1 + skip if 0 < skip < len(data) else 0
            data = data[skip:]
        if not start:
            window = most
            while True:
                f.seek(0)
                data = f.read(window)
                n_read += len(data)
                if b"\n" in data or len(data) >= size or window >= largest:
                    break
                window *= 2
    found, at = [], start
    for raw in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]:
        found.append((at, raw))
        at += len(raw) + 1
    return found, size, start > 0, n_read


def heads(files: DataFrame, most: int, lines: int) -> DataFrame:
    """(file_path, pos, raw, n_read): the first lines of files (file_path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    found, n_read = first_lines(path, most, lines)
                except FileNotFoundError:
                    continue
                rows = [(path, k, raw.decode("utf-8", "replace"), 0 if k else n_read) for k, raw in enumerate(found)]
                yield pa.RecordBatch.from_pylist([dict(zip(("file_path", "pos", "raw", "n_read"), r)) for r in rows], pa.schema([("file_path", pa.string()), ("pos", pa.int64()), ("raw", pa.string()), ("n_read", pa.int64())]))

    return files.select("file_path").mapInArrow(run, "file_path string, pos long, raw string, n_read long")


def tails(files: DataFrame, most: int) -> DataFrame:
    """(file_path, size, offset, raw, truncated, n_read): the last lines of files (file_path), a file a batch."""
    kinds = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("raw", pa.string()), ("truncated", pa.bool_()), ("n_read", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    found, size, truncated, n_read = last_lines(path, most)
                except FileNotFoundError:
                    continue
                rows = [(path, size, at, raw.decode("utf-8", "replace"), truncated, 0 if k else n_read) for k, (at, raw) in enumerate(found)]
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)

    return files.select("file_path").mapInArrow(run, "file_path string, size long, offset long, raw string, truncated boolean, n_read long")


def listed(spark, paths: list[str] | str) -> DataFrame:
    """(file_path, file_size) of files or folders; their contents are not read."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
