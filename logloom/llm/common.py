"""Shared pieces: word hashing over Arrow buffers, fold remainders and the shared scratch folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: everything but space and the control characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes hashed at a time; bounds the 8-byte temporaries whatever a batch or a text measures.
_CHUNK = 1 << 19
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], filled, step = 1, 1, base & _MASK
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled += more
        step = step * step & _MASK
    return out


_POW = _powers(_P, _CHUNK * 2)
_INV = _powers(pow(_P, -1, 1 << 64), _CHUNK * 2)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry: the end). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hash_words(raw: np.ndarray, at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, begin, end): a 64-bit hash of each word, each text's first word (one more entry:
    the number of words), and the bytes at which each word begins and ends. fold: lower-case A-Z first."""
    blank = _BLANK[raw]
    fresh = np.empty(len(raw), bool)
    fresh[:1], fresh[1:] = True, blank[:-1]
    fresh[at[:-1][at[:-1] < len(raw)]] = True
    fresh &= ~blank
    begin = np.flatnonzero(fresh)
    first = np.searchsorted(begin, at)
    # a word ends before the next blank or the next text
    ends = np.append(np.flatnonzero(blank | fresh), len(raw))
    end = ends[np.searchsorted(ends, begin, "right")] if len(begin) else begin
    hashes = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        lo = begin[k]
        m = max(k + 1, int(np.searchsorted(begin, lo + _CHUNK)))
        if end[m - 1] - lo > 2 * _CHUNK:
            m = max(k + 1, m - 1)
        hi = end[m - 1]
        if hi - lo > 2 * _CHUNK:  # one huge word: fold it piece by piece
            h = 0
            for a in range(lo, hi, _CHUNK):
                piece = raw[a : min(hi, a + _CHUNK)]
                piece = _FOLD[piece] if fold else piece
                h = (h + int(((piece.astype(np.uint64) + np.uint64(1)) * _POW[: len(piece)]).sum()) * pow(_P, int(a - lo), 1 << 64)) & _MASK
            hashes[k] = h
        else:
            piece = raw[lo:hi]
            part = (_FOLD[piece] if fold else piece).astype(np.uint64)
            part += np.uint64(1)
            part *= _POW[: hi - lo]
            part[blank[lo:hi]] = 0
            own = begin[k:m] - lo
            hashes[k:m] = np.add.reduceat(part, own) * _INV[own]
        k = m
    return mix64(hashes + (end - begin).astype(np.uint64)), first, begin, end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, over all of ``words`` without regard to texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : len(words) - n + 1 + k]
    return mix64(out)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    texts = batch.column(column)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def barrier(sql: str) -> Column:
    """The expression, kept where it stands: the optimizer copies no filter above it, and so no second
    computation inside an array function's loop, below a column that it holds not to be deterministic."""
    return F.expr(f"IF(spark_partition_id() >= 0, {sql}, NULL)")


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_az(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def remainder(column: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % of).cast("int")


_own_dir: list[str] = []
#: Tables are written in quick succession; the driver tidies up after one of them this often.
SETTLE_SECONDS = 5.0
_settled = [0.0]
_libc = ctypes.CDLL(None)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names. Where that is unset a session on one machine gets
    a temporary one; on a cluster there is none that all would share, so it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="logloom-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/logloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - _settled[0] > SETTLE_SECONDS:
        settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._logloom_path = path
    return out


#: Bytes of a written file that ``packed`` aims at, at least.
FILE_BYTES = 128 << 20


def packed(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, or as its sources have FILE_BYTES: a step over little data leaves few
    files in the shared folder instead of one a partition. Partitions are not shuffled, only run one after the other, and
    each still is a partition to what maps over it; nothing here may go by their numbers."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    most = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    return df.coalesce(most) if most < 1 << 20 else df


def gathered(df: DataFrame) -> DataFrame:
    """materialise in few files."""
    return materialise(packed(df))


def settle(spark: SparkSession) -> None:
    """Gives the driver's unused memory back, and lets Spark delete shuffle files that nothing refers to: it
    learns of them as the driver collects garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
    spark._jvm.System.gc()
    _settled[0] = time.monotonic()


def discard(df: DataFrame) -> None:
    """Deletes a materialised table that nothing reads any more."""
    path, spark = df._logloom_path, df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Places of a membership bitmap (2 MB): a bound for what is broadcast, whatever the number of keys.
BITMAP = 1 << 24


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bytes of a bitmap with the place of every key (a long) set, gathered by place. False positives grow
    with the number of keys; callers join exactly afterwards."""
    rows = (
        keys.where(F.col(column).isNotNull())
        .select(F.pmod(F.xxhash64(column), F.lit(BITMAP)).alias("at"))
        .select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITMAP // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def only_in(df: DataFrame, column: str, keys: DataFrame, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """The rows of df whose key is in keys, and a few more: filtered where they are read, before any shuffle.
    then: what to make of their batches in the same pass (one Python worker a task), giving schema."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap(keys, column))
    placed = df.withColumn("__at", F.pmod(F.xxhash64(column), F.lit(BITMAP)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("__at").to_numpy()
            own = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            if own.num_rows:
                yield own.drop_columns(["__at"])

    return placed.mapInArrow((lambda batches: then(kept(batches))) if then else kept, schema or df.schema)


#: Rows of an Arrow batch at most; ten thousand long texts in one batch would not fit a worker.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of sf_dir; also bounds the session's Arrow batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
