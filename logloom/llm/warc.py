"""Merkle fixity audit of web archives.

Records get a SHA-256 of their WARC bytes and a place: a file and the ordered offset range in it. Above
the records of a file stands a tree of FANOUT; a node hashes its children's numbers, lengths and hashes in
order (offsets follow from the lengths before). Each replica has a tree of its own. Two are compared root by
root; only below roots that differ, or that one replica lacks, are children compared, level by level, down to
the records. Records at places that differ are then paired by id and bytes, across files: what is left over
is damaged, missing or added, and what has a pair is moved. Everything is DataFrame expressions but for
reading and writing WARC files.

Null urls and bodies count as empty. Repeated rows are records of their own. An empty archive gives an empty
report.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read

FANOUT = 8
LEVELS = 3
FILE_RECORDS = FANOUT**LEVELS


def record_bytes(key: str, url: str, body: bytes) -> bytes:
    """One uncompressed WARC/1.0 resource record."""
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{key}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of a plain or gzipped file; offsets are of the plain bytes."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:] if ": " in line)
        size = int(headers["Content-Length"])
        body, stop = raw[end + 4 : end + 4 + size], end + 4 + size + 4
        if len(body) < size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, stop - at, headers, body
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, key, url, body, hash) of the records in WARC files, plain or .gz."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for p, c in zip(frame["path"], frame["content"]):
                raw = gzip.decompress(c) if c[:2] == b"\x1f\x8b" else bytes(c)
                rows += [(p, o, n, h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), b, hashlib.sha256(raw[o : o + n]).hexdigest()) for o, n, h, b in parse(raw)]
            yield pd.DataFrame(rows, columns=["file", "offset", "length", "key", "url", "body", "hash"])

    kinds = "file string, offset long, length long, key string, url string, body binary, hash string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kinds)


def leaves_of(records: DataFrame, root: str = "") -> DataFrame:
    """The leaves (file, i, page_id, at, length, hash) of what read_warc gives. root: the folder of this replica, taken off the files' names."""
    file = F.substring_index("file", root, -1) if root else F.col("file")
    named = records.select(file.alias("file"), F.col("key").alias("page_id"), F.col("offset").alias("at"), "length", "hash")
    return named.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("long").alias("i"), "page_id", "at", "length", "hash")


def write_warc(rows: Iterator[tuple[str, str, bytes]], compress: bool = True) -> bytes:
    """A WARC file of (key, url, body), each record its own gzip member."""
    out = io.BytesIO()
    for key, url, body in rows:
        record = record_bytes(key, url, body)
        out.write(gzip.compress(record, mtime=0) if compress else record)
    return out.getvalue()


def record_column(key: Column, url: Column, body: Column) -> Column:
    """record_bytes as an expression."""
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body.cast("string"), F.lit(""))
    lines = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", "null", ">\r\nWARC-Target-URI: ", "\r\nContent-Type: text/html\r\nContent-Length: ", "\r\n\r\n"]
    return F.concat(
        F.lit(lines[0]), F.coalesce(key.cast("string"), F.lit(lines[1])), F.lit(lines[2]), url,
        F.lit(lines[3]), F.octet_length(body).cast("string"), F.lit(lines[4]), body, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, replica: Column | None = None) -> DataFrame:
    """(file, i, page_id, length, hash, copy, copy_length, at): a leaf a record, in files of FILE_RECORDS by page_id.
    copy, copy_length: of ``replica``, the body as another replica has it (None: the same)."""
    mine = record_column(F.col("page_id"), F.col("url"), F.col("html"))
    other = mine if replica is None else record_column(F.col("page_id"), F.col("url"), replica)
    leaves = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.monotonically_increasing_id().alias("tie"),
        F.octet_length(mine).cast("long").alias("length"),
        F.sha2(mine.cast("binary"), 256).alias("hash"),
        F.sha2(other.cast("binary"), 256).alias("copy"),
        F.octet_length(other).cast("long").alias("copy_length"),
    )
    leaves = materialise(leaves)
    ranged = leaves.repartitionByRange("page_id", "tie").sortWithinPartitions("page_id", "tie")
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("nth")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row a partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.join(F.broadcast(before), "part").select("*", (F.col("before") + F.col("nth")).alias("k"))
    own = Window.partitionBy("file").orderBy("i")
    return numbered.select(
        F.expr(f"k div {FILE_RECORDS}").alias("file"), (F.col("k") % FILE_RECORDS).alias("i"), "page_id", "length", "hash", "copy", "copy_length"
    ).select("*", (F.sum("length").over(own) - F.col("length")).alias("at"))


def copied(leaves: DataFrame) -> DataFrame:
    """The leaves (file, i, page_id, at, length, hash) of the replica beside an archive's; numbers and offsets are its own."""
    own = Window.partitionBy("file").orderBy("i", "page_id", "copy")
    return leaves.select(
        "file", (F.row_number().over(own) - 1).cast("long").alias("i"), "page_id",
        (F.sum("copy_length").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copy_length")).alias("at"),
        F.col("copy_length").alias("length"), F.col("copy").alias("hash"),
    )


def level_above(nodes: DataFrame) -> DataFrame:
    """The parents of nodes (file, i, length, hash)."""
    grouped = nodes.groupBy("file", F.expr(f"i div {FANOUT}").alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("i", "length", "hash"))).alias("x")  # FANOUT at most
    )
    return grouped.select(
        "file",
        F.col("up").alias("i"),
        F.expr("aggregate(x, 0L, (a, c) -> a + c.length)").alias("length"),
        F.sha2(F.expr("array_join(transform(x, c -> concat_ws(':', c.i, c.length, c.hash)), '|')"), 256).alias("hash"),
    )


def _tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    levels = [leaves]
    for _ in range(height):
        levels.append(materialise(level_above(levels[-1].select("file", "i", "length", "hash"))))
    return levels


def audit(leaves: DataFrame, replica: DataFrame | None = None) -> DataFrame:
    """A row for each file of either replica: file, n_records, n_bytes (of leaves), intact, n_compared, and ids by offset: damaged
    (and damaged_at; records whose bytes the replica has nowhere), missing (those of them whose id it lacks too), moved (bytes
    it has at another place), added (its records that leaves lack). replica: leaves of its own (None: the copy beside the leaves)."""
    leaves = materialise(leaves)
    copy = materialise(copied(leaves) if replica is None else replica)
    columns = ("file", "i", "page_id", "at", "length", "hash")
    ours, theirs = leaves.select(*columns), copy.select(*columns)
    last = ours.select("i").unionByName(theirs.select("i")).agg(F.coalesce(F.max("i"), F.lit(0))).first()[0]
    height = LEVELS
    while FANOUT**height <= last:
        height += 1
    bad, compared = None, None
    for a, b in zip(reversed(_tree(ours, height)), reversed(_tree(theirs, height))):
        if bad is not None:
            up = bad.select("file", F.col("i").alias("up"))
            a, b = (x.withColumn("up", F.expr(f"i div {FANOUT}")).join(up, ["file", "up"]).drop("up") for x in (a, b))
        a, b = (x.select("file", "i", F.struct(*(c for c in x.columns if c not in ("file", "i"))).alias(n)) for x, n in ((a, "a"), (b, "b")))
        both = materialise(a.join(b, ["file", "i"], "full_outer"))
        n = both.groupBy("file").agg(F.count("*").alias("n"))
        compared = n if compared is None else compared.unionByName(n)
        bad = both.where("NOT (a.hash <=> b.hash)")
    # pairs of equal id and bytes are moved; of the rest, pairs of equal id are changed
    sides = [bad.where(f"{x} IS NOT NULL").select("file", "i", f"{x}.*").withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))) for x in ("a", "b")]

    def paired(a: DataFrame, b: DataFrame, *by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("file", "i")).alias("nth")
        x, y = (d.select(*by, nth, F.struct(*d.columns).alias(n)) for d, n in ((a, "a"), (b, "b")))
        whole = materialise(x.join(y, [*by, "nth"], "full_outer").select("a", "b"))
        return whole.where("a IS NOT NULL AND b IS NOT NULL").select("a.*"), whole.where("b IS NULL").select("a.*"), whole.where("a IS NULL").select("b.*")

    moved, mine, others = paired(*sides, "key", "hash")
    changed, missing, added = paired(mine, others, "key")
    kinds = [d.withColumn("kind", F.lit(k)) for k, d in (("moved", moved), ("changed", changed), ("missing", missing), ("added", added))]
    marked = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    listed = lambda *k: F.sort_array(F.collect_list(F.when(F.col("kind").isin(*k), F.struct("at", "page_id"))))
    found = marked.groupBy("file").agg(
        listed("changed", "missing").alias("x"), listed("missing").alias("missing"), listed("moved").alias("moved"), listed("added").alias("added")
    )  # of one file
    total = ours.groupBy("file").agg(F.count("*").alias("n_records"), F.sum("length").alias("n_bytes"))
    ids = lambda c: F.coalesce(F.col(f"{c}.page_id"), F.array().cast(f"array<{leaves.schema['page_id'].dataType.simpleString()}>"))
    zero = F.lit(0).cast("long")
    return (
        compared.groupBy("file").agg(F.sum("n").alias("n_compared"))
        .join(total, "file", "left")
        .join(found, "file", "left")
        .select(
            "file", F.coalesce("n_records", zero).alias("n_records"), F.coalesce("n_bytes", zero).alias("n_bytes"), F.col("x").isNull().alias("intact"), "n_compared",
            ids("x").alias("damaged"), F.coalesce(F.col("x.at"), F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("damaged_at"),
            ids("missing").alias("missing"), ids("moved").alias("moved"), ids("added").alias("added"),
        )
    )


def rotten(key: Column, body: Column, one_in: int = 97) -> Column:
    """body as a failing disk would keep it: one record in ``one_in`` has its first character changed."""
    changed = F.concat(F.lit("\x01"), F.substr(F.coalesce(body, F.lit("")), F.lit(2)))
    return F.when(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0, changed).otherwise(body)


def failing(key: Column, body: Column) -> Column:
    """rotten, and one record in 1,940 is cut short."""
    return F.when(_fate(key) == 0, F.substr(F.coalesce(body, F.lit("")), F.lit(1), F.lit(40))).otherwise(rotten(key, body))


def _fate(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(1940))


def scattered(leaves: DataFrame) -> DataFrame:
    """An archive's copies as a replica that has lost, repeated and moved one record in 1,940 each: the second copy
    goes to the end of the file, what is moved to the end of the next one."""
    fate, end = _fate(F.col("page_id")), F.col("i") + F.lit(1 << 40)
    kept = leaves.where(fate.isNull() | ~fate.isin(1))
    placed = kept.withColumn("file", F.col("file") + F.when(fate == 3, 1).otherwise(0)).withColumn("i", F.when(fate == 3, end).otherwise(F.col("i")))
    return copied(placed.unionByName(leaves.where(fate == 2).withColumn("i", end)))


def op8_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica with damage in about one record of 97, and records lost,
    repeated, moved or cut short in about one of 485."""
    pages = read(spark, sf_dir, "pages")
    leaves = materialise(archive(pages, failing(F.col("page_id"), F.col("html"))))
    return audit(leaves, scattered(leaves))
