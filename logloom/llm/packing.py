"""Bulk-synchronous best-fit packing of tokenised documents into fixed-size sequences.

Lengths and gaps are integers up to the capacity, so the range-sorted order of all pieces and of
all gaps is a sequence of runs of equal keys. The order of the pieces is a distributed counting
sort: each task ranks its own pieces within every length, and the tasks' counts are summed into
offsets. A sweep then walks lengths and gaps together from large to small; each piece takes the
smallest gap that holds it (its successor), conflicts go to the higher rank, gaps shrink and the
sweep repeats. The sweeps see run lengths, never rows, so what reaches the driver is bounded by
the capacity and does not grow with the documents.

Null texts count as empty (one end id). Repeated rows are packed each on its own. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, read

CAPACITY = 2048
END_ID = 0
#: The one special token whose text the tokenizer file turns into an id of its own.
SPECIAL = {"<|endoftext|>": 50256}

_encodings: dict = {}


def encoding(ranks_path: str, pattern: str):
    """The byte-level vocabulary as a tiktoken encoding; one for each worker process."""
    if ranks_path not in _encodings:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encodings[ranks_path]


def tokenizer_files() -> tuple[str, str]:
    """The ranks of byte_bpe_50k.json's vocabulary in tiktoken's form, which gives the same ids (see the
    tests) in a fifth of the time, and the pattern of its words."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes what is over."""
    head = n % capacity or capacity
    return [(0, min(head, n))] + [(s, capacity) for s in range(head, n, capacity)]


def tokenise(docs: DataFrame, files: tuple[str, str], capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and part and rank: the task and the
    piece's place among the task's pieces of the same length."""
    path, pattern = files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoding(path, pattern), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray(enc.encode_to_numpy(text.as_py() or "", allowed_special="all"), "<u4")
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    row = (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), int(seen[length]))
                    seen[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(out, kinds)), pa.array(np.full(len(out[0]), part), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part long"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Sweeps over run lengths. Rows (length, first rank, first sequence, offset, count): of the pieces of a
    length, those from first rank on go to sequences from first sequence on, at that offset."""
    left = {n: [0, c] for n, c in counts.items() if c}  # length: next rank, how many
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, count)
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(length: int, gap: int, first: int, count: int, into: dict) -> None:
        rank, have = left[length]
        placed.append((length, rank, first, capacity - gap, count))
        left[length] = [rank + count, have - count]
        if have == count:
            del left[length]
        if gap > length:
            into.setdefault(gap - length, []).append((first, count))

    while left:
        matched = False
        after: dict[int, list[tuple[int, int]]] = {}
        stack: list[tuple[int, int, int]] = []
        for size in sorted({*left, *gaps}, reverse=True):
            stack += [(size, *run) for run in reversed(gaps.get(size, ()))]
            while size in left and stack:
                gap, first, have = stack.pop()
                count = min(have, left[size][1])
                place(size, gap, first, count, after)
                matched = True
                if count < have:
                    stack.append((gap, first + count, have - count))
        smallest = min(left, default=capacity + 1)
        for gap, first, count in stack:
            if gap >= smallest:
                after.setdefault(gap, []).append((first, count))
        gaps = {g: runs for g, runs in after.items() if g >= smallest}
        if not matched and left:
            # nothing left fits a gap: what is over half opens its own sequence, else as many as the rest needs at least
            big = [n for n in sorted(left, reverse=True) if 2 * n > capacity]
            need = sum(left[n][1] for n in big) or math.ceil(sum(n * c for n, (_, c) in left.items()) / capacity)
            for n in big or sorted(left, reverse=True):
                count = min(need, left[n][1])
                place(n, capacity, opened, count, gaps)
                opened, need = opened + count, need - count
                if not need:
                    break
    rows = np.array(sorted(placed), np.int64).reshape(-1, 5)
    return rows


def pack(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark = docs.sparkSession
    table = materialise(tokenise(docs, files or tokenizer_files(), capacity))
    counts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    # one row a length, capacity rows at most
    rows = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = counts.select(
        "length",
        "part",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    shared = spark.sparkContext.broadcast((rows[:, 0] << 44 | rows[:, 1], rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n).to_numpy() for n in ("rank", "before", "length")}
            rank = cols["rank"] + cols["before"]
            at = rows[np.searchsorted(keys, cols["length"] << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return table.join(before, ["length", "part"]).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
