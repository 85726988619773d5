"""Prefix trie of conversations, by way of a Patricia tree.

A conversation is a path: 16 bytes a turn, 12 of a digest of role and text and 4 of the text's length, so that paths
sort turn by turn and carry all that a node needs. Texts are left behind before the first shuffle.

1. Paths are range-partitioned and sorted, ties by conversation, so equal paths may lie in several partitions.
2. Each task follows its sorted paths with a stack and makes points only: where paths end, where neighbours part,
   and the root. A point that is complete in the task (no path of another partition can pass it: it lies neither
   on the task's first path nor on its last) is closed and given out with the aggregates of its subtree.
3. What is left of a task are the points on two paths. One task follows those of all partitions in order, by the
   same stack; they number at most the depth of two paths a partition, whatever a partition holds.
4. A point is expanded to the nodes of its edge. Members, leaves and ends don't change along an edge; the savings
   do by suffix sums of the edge's text lengths.

A point's parent is mostly closed in the same task; else it is known by task and number and joined. Digests of the
members that end at a point are made where the point is closed. Where their list is long or goes on in another
partition it travels in pieces of MANY ids, and a task streams a point's pieces, in order, through the digest.

Null roles and texts count as empty; turns that tie are ordered by role, then by a digest of the text; rows without
a conversation's id belong to none and are left out; repeated rows are turns of their own. Other columns are ignored,
and an empty table gives no node. The hundred that a negative id belongs to is the one that begins below it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, read

KEY = 16
#: Conversations of a block share the beginnings of the one that the block is named for.
BLOCK, SHARED = 100, 6
#: Rows and ids that a point gathers before they go on their way by reference; rows of an Arrow batch.
MANY, ROWS = 1 << 14, 4096
NOBODY = (1 << 63) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "kind string, pid int, serial long, conv_id long, depth long, up long, n_convs long, n_children long, n_leaves long, savings array<long>, ends string, parent_conv_id long, parent_serial long, nth long, path binary, ids string, inner long"
_NAMES = [c.split()[0] for c in NODE.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key): each turn's digest and text length, as 32 hexadecimal digits."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    size = F.lpad(F.hex(F.char_length(text)), 8, "0")
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.concat(F.substr(digest, F.lit(1), F.lit(2 * KEY - 8)), size).alias("key"))


def rebuilt(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """(conv_id, path): every conversation with its first turns, up to shared - 1 by a hash of its id, taken from the
    conversation that its block is named for. One shuffle, by block."""
    dealt = turns(conversations).withColumn("block", F.col("conv_id") - F.pmod("conv_id", F.lit(block))).repartition("block")
    own = dealt.groupBy("block", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key"))).alias("x"))  # one conversation
    keyed = own.select("block", "conv_id", F.transform("x", lambda t: t["key"]).alias("keys"))
    first = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("keys", F.lit(1), F.lit(shared - 1)))).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    headed = keyed.select("conv_id", "keys", F.coalesce(first, F.slice("keys", F.lit(1), F.lit(0))).alias("head"), h.alias("h"))
    whole = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("keys", F.col("h") + 1, F.size("keys")))
    return headed.select("conv_id", F.unhex(F.array_join(whole, "")).alias("path"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    x, y = (np.frombuffer(p, np.uint64, n // 8) for p in (a, b))
    return int(np.argmax(x != y)) // 2


class Point:
    __slots__ = ("depth", "serial", "n", "low", "children", "leaves", "inner", "ids", "pieces", "ends", "pending", "named", "refs")

    def __init__(self, depth: int, serial: int) -> None:
        self.depth, self.serial = depth, serial
        self.n = self.children = self.leaves = self.inner = self.pieces = 0
        self.low, self.ends, self.named = NOBODY, False, False
        self.ids: list[int] = []
        self.pending: list[dict] = []
        self.refs: list[tuple[int, int]] = []


class Patricia:
    """Follows sorted paths. ``out`` has the rows that can go. spines: keep open what lies on the first or last path."""

    def __init__(self, spines: bool, many: int = MANY) -> None:
        self.spines, self.many, self.made = spines, many, 0
        self.out: list[dict] = []
        self.path, self.first, self.left = b"", None, -1
        self.stack = [self._point(0)]
        self.popped: list[Point] = []  # open points of the first path that the last one lacks, deepest first

    def _point(self, depth: int) -> Point:
        self.made += 1
        return Point(depth, self.made - 1)

    def follow(self, path: bytes) -> None:
        """Goes on to a path that doesn't sort before the one before it."""
        alike = common_turns(self.path, path)
        self._climb(alike)
        if self.first is None:
            self.first = path
            self.left = len(path) // KEY if self.spines else -1
        else:
            self.left = min(self.left, alike)
        self.path = path

    def at(self, depth: int) -> Point:
        """The point of the present path at a depth."""
        k = bisect_left(self.stack, depth, key=lambda p: p.depth)
        if k == len(self.stack) or self.stack[k].depth > depth:
            self.stack.insert(k, self._point(depth))
        return self.stack[k]

    def ends_at(self, path: bytes, conv: int) -> None:
        """A conversation ends at the path."""
        self.follow(path)
        point = self.at(len(path) // KEY)
        point.n, point.low, point.ends = point.n + 1, min(point.low, conv), True
        point.ids.append(conv)
        if len(point.ids) >= self.many:
            self._send_ids(point)

    def _climb(self, depth: int) -> None:
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(self._point(depth))
            if point.depth <= self.left:
                self.popped.append(point)
            else:
                self._close(point, self.stack[-1])

    def _send_ids(self, point: Point) -> None:
        if point.ids:
            self.out.append({"kind": "ids", "serial": point.serial, "nth": point.pieces, "ids": ",".join(map(str, point.ids))})
            point.ids, point.pieces = [], point.pieces + 1

    def _row(self, point: Point, up: int, savings: np.ndarray) -> dict:
        ends = NO_ENDS
        if point.ends and (point.pieces or point.refs):
            self._send_ids(point)
            ends = None
        elif point.ends:
            ends = hashlib.sha256(",".join(map(str, point.ids)).encode()).hexdigest()
        # in a tree of spines a point's lists go by the name of its first part
        pid, serial = point.refs[0] if point.refs else (None, point.serial)
        if point.named:
            self.out.append({"kind": "name", "serial": point.serial, "conv_id": point.low})
        for ref in point.refs:
            self.out.append({"kind": "name", "pid": ref[0], "serial": ref[1], "conv_id": point.low, "nth": pid, "inner": serial})
        for row in point.pending:
            row["parent_conv_id"] = point.low
        self.out += point.pending
        return {
            "kind": "node", "pid": pid, "serial": serial, "conv_id": point.low, "depth": point.depth, "up": up, "n_convs": point.n,
            "n_children": point.children, "n_leaves": point.leaves or 1, "savings": savings, "ends": ends,
        }

    def _close(self, point: Point, parent: Point) -> None:
        sizes = np.frombuffer(self.path[KEY * parent.depth : KEY * point.depth], ">u4")[3::4].astype(np.int64)
        savings = point.inner + (point.n - 1) * np.cumsum(sizes[::-1])
        row = self._row(point, parent.depth, savings)
        parent.n, parent.low, parent.children = parent.n + point.n, min(parent.low, point.low), parent.children + 1
        parent.leaves, parent.inner = parent.leaves + row["n_leaves"], parent.inner + int(savings[-1])
        if parent.depth <= self.left:
            self.out.append(row | {"parent_serial": parent.serial})
            return
        parent.pending.append(row)
        if len(parent.pending) >= self.many:
            self._refer(parent)
            parent.named = True

    def _refer(self, parent: Point) -> None:
        """What waits for the parent's name goes on with its number."""
        self.out += [row | {"parent_serial": parent.serial} for row in parent.pending]
        parent.pending = []

    def open(self) -> None:
        """Gives out what is left: two paths, each before its points; those of both stand with the first."""
        if self.first is None:
            return
        both = [p for p in self.stack if p.depth <= self.left]
        rest: list[dict] = []
        for path, points in ((self.first, both + self.popped[::-1]), (self.path, self.stack[len(both) :])):
            rest.append({"kind": "path", "nth": len(rest), "path": path})
            for point in points:
                self._refer(point)
                self._send_ids(point)
                rest.append({
                    "kind": "open", "serial": point.serial, "conv_id": point.low, "depth": point.depth, "n_convs": point.n, "n_children": point.children,
                    "n_leaves": point.leaves, "inner": point.inner, "nth": len(rest), "ends": "" if point.ends else None,
                })
        self.out += rest

    def join(self, row: dict) -> None:
        """Goes on with a row that open gave out."""
        if row["kind"] == "path":
            return self.follow(row["path"])
        point = self.at(row["depth"])
        point.n, point.low, point.ends = point.n + row["n_convs"], min(point.low, row["conv_id"]), point.ends or row["ends"] is not None
        point.children, point.leaves, point.inner = point.children + row["n_children"], point.leaves + row["n_leaves"], point.inner + row["inner"]
        point.refs.append((row["pid"], row["serial"]))

    def close(self) -> None:
        """Closes all points, the root too."""
        if self.first is not None:
            self._climb(0)
            root = self.stack[0]
            self.out.append(self._row(root, -1, np.array([root.inner])))

    def take(self) -> list[dict]:
        rows, self.out = self.out, []
        return rows


def _batches(rows: Iterable[list[dict]], pid: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches; those without a task's number get ``pid``."""
    schema = pa.schema([(n, t) for n, t in zip(_NAMES, _ARROW)])
    held: list[dict] = []
    for some in rows:
        held += some
        while len(held) >= ROWS:
            yield _batch(held[:ROWS], schema, pid)
            held = held[ROWS:]
    if held:
        yield _batch(held, schema, pid)


_ARROW = [
    {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in NODE.split(", ")
]


def _batch(rows: list[dict], schema: pa.Schema, pid: int | None) -> pa.RecordBatch:
    columns = [[r.get(n) for r in rows] for n in _NAMES]
    columns[1] = [pid if p is None else p for p in columns[1]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of a task's sorted (path, conv_id)."""

    def run() -> Iterator[list[dict]]:
        tree = Patricia(spines=True)
        for batch in batches:
            for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree.ends_at(path, conv)
                if len(tree.out) >= ROWS:
                    yield tree.take()
        tree.open()
        yield tree.take()

    return _batches(run(), TaskContext.get().partitionId())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of what all tasks left open, ordered by task and place."""

    def run() -> Iterator[list[dict]]:
        tree = Patricia(spines=False, many=NOBODY)
        for batch in batches:
            for row in batch.to_pylist():
                tree.join(row)
        tree.close()
        yield tree.take()

    return _batches(run())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, serial, ends) of pieces of lists (pid, serial, ids) that lie in order."""
    last, digest = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int64()), pa.array([digest.hexdigest()])], ["pid", "serial", "ends"])
    for batch in batches:
        for pid, serial, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (pid, serial) != last:
                if last is not None:
                    yield out()
                last, digest = (pid, serial), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if last is not None:
        yield out()


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row a node of the trie of (conv_id, path); a conversation has one path. conv_id: the smallest member; depth;
    parent_conv_id; n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    paths = materialise(paths.select("path", "conv_id"))
    ranged = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = materialise(ranged.mapInArrow(_points, NODE))
    # at most the points of two paths a partition
    left = made.where("kind IN ('open', 'path')").repartition(1).sortWithinPartitions("pid", "nth")
    joined = materialise(left.mapInArrow(_joined, NODE))
    names = joined.where("kind = 'name'").select("pid", "serial", "conv_id", F.col("nth").cast("int").alias("owner"), F.col("inner").alias("owner_serial"))
    own_names = made.where("kind = 'name'").select("pid", "serial", "conv_id")

    lists = made.where("kind = 'ids'").select("pid", "serial", "nth", "ids").join(names.drop("conv_id"), ["pid", "serial"], "left")
    owned = lists.select(F.coalesce("owner", "pid").alias("owner"), F.coalesce("owner_serial", "serial").alias("owner_serial"), "ids", "pid", "nth")
    ordered = owned.repartition("owner", "owner_serial").sortWithinPartitions("owner", "owner_serial", "pid", "nth").select("owner", "owner_serial", "ids")
    digests = ordered.mapInArrow(_digests, "pid int, serial long, ends string")

    nodes = ("pid", "serial", "conv_id", "depth", "up", "n_convs", "n_children", "n_leaves", "savings")
    points = made.where("kind = 'node'")
    parents = names.select("pid", "serial", "conv_id").unionByName(own_names).select("pid", F.col("serial").alias("parent_serial"), F.col("conv_id").alias("parent_conv_id"))
    referred = points.where("parent_serial IS NOT NULL").select(*nodes, "ends", "parent_serial").join(parents, ["pid", "parent_serial"], "left").select(*nodes, "parent_conv_id", "ends")
    all_points = referred.unionByName(points.where("parent_serial IS NULL").select(*nodes, "parent_conv_id", "ends"))
    all_points = all_points.unionByName(joined.where("kind = 'node'").select(*nodes, "parent_conv_id", "ends"))
    hashed = all_points.where("ends IS NULL").drop("ends").join(digests, ["pid", "serial"], "left").select(*nodes, "parent_conv_id", "ends")
    whole = all_points.where("ends IS NOT NULL").unionByName(hashed)

    edge = whole.select("*", F.posexplode("savings").alias("above", "saved_tokens"))
    depth, lowest = F.col("depth") - F.col("above"), F.col("above") == 0
    return edge.select(
        "conv_id", depth.alias("depth"), F.when(depth == F.col("up") + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(lowest, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.when(lowest, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations, rebuilt."""
    return prefix_trie(rebuilt(read(spark, sf_dir, "conversations")))
