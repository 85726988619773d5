"""Frames for listeners: what every trigger of a query brings, kept by batch, and how far each listener has read.

A batch's frames are one folder by its number, so a batch that a restarted query hands over again replaces itself and
sends nothing twice. A listener's place is (batch, frame), kept as a small file that is replaced whole: a listener
that comes back goes on where it was, whichever driver answers it. Frames that all listeners have read can be dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = "n long, frame string, batch long"


class FrameSink:
    """Hand it to ``live.watch``. kind: what the frames are called; order: the columns that a batch's rows go by."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "events", order: tuple[str, ...] = ("path", "offset")):
        self.spark, self.root, self.kind, self.order = spark, root.rstrip("/"), kind, order
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Writes a batch's frames in the place of what was there under its number. As many rows as a trigger takes."""
        place = F.row_number().over(Window.orderBy(*self.order)).cast("long").alias("n")
        numbered = batch.select(F.struct(*batch.columns).alias("row"), place)
        framed = numbered.select("n", F.to_json(F.struct(F.lit(self.kind).alias("kind"), F.col("row").alias("data"))).alias("frame"))
        framed.write.mode("overwrite").parquet(f"{self.root}/frames/batch={number}")

    def batches(self) -> list[int]:
        """The numbers of the batches that are whole."""
        folder = self._path(f"{self.root}/frames")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        whole = [n for n in names if n.startswith("batch=") and self._fs.exists(self._path(f"{self.root}/frames/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in whole)

    def _place_file(self, listener: str) -> str:
        if not listener or any(not (c.isalnum() or c in "-_") for c in listener):
            raise ValueError(f"{listener!r} can't name a listener")
        return f"{self.root}/listeners/{listener}.json"

    def place(self, listener: str) -> tuple[int, int] | None:
        """(batch, frame) that the listener has read last; None where it has never been here."""
        path = self._path(self._place_file(listener))
        if not self._fs.exists(path):
            return None
        row = self.spark.read.text(path.toString()).first()
        told = json.loads(row["value"])
        return told["batch"], told["n"]

    def _keep(self, listener: str, batch: int, n: int) -> None:
        final = self._path(self._place_file(listener))
        fresh = self._path(final.toString() + ".new")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"batch": batch, "n": n}).encode()))
        out.close()
        self._fs.delete(final, False)
        self._fs.rename(fresh, final)

    def attach(self, listener: str, history: int = 0) -> None:
        """A new listener begins behind the newest batch, or ``history`` batches before; a known one stays where it was."""
        if self.place(listener) is None:
            known = self.batches()
            begin = known[-1 - history] if len(known) > history else -1
            self._keep(listener, begin, 1 << 62)

    def poll(self, listener: str, limit: int = 500) -> list[str]:
        """The next frames, ``limit`` at most; what is given out counts as read. Only folders from the place on are read."""
        at = self.place(listener)
        if at is None:
            raise ValueError(f"{listener!r} is not attached")
        ahead = [b for b in self.batches() if b >= at[0]]
        if not ahead:
            return []
        rows = self.spark.read.schema(FRAMES).option("basePath", f"{self.root}/frames").parquet(*(f"{self.root}/frames/batch={b}" for b in ahead))
        new = rows.where((F.col("batch") > at[0]) | ((F.col("batch") == at[0]) & (F.col("n") > at[1]))).orderBy("batch", "n").limit(limit).collect()
        if new:
            self._keep(listener, new[-1]["batch"], new[-1]["n"])
        return [r["frame"] for r in new]

    def detach(self, listener: str) -> None:
        self._fs.delete(self._path(self._place_file(listener)), False)

    def prune(self) -> int:
        """Drops the batches that every listener has left behind; all but the newest where there is none."""
        folder = self._path(f"{self.root}/listeners")
        names = [s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        known = self.batches()
        least = min([self.place(n)[0] for n in names if not n.endswith(".new") and not n.startswith(".")], default=known[-1] if known else 0)
        gone = [b for b in known if b < least]
        for b in gone:
            self._fs.delete(self._path(f"{self.root}/frames/batch={b}"), True)
        return len(gone)
