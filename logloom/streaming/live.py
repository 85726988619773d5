"""Streaming over tailed lines: events, arrivals with a time to live, and frames for listeners."""

from __future__ import annotations

import ast
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.functions.blocks import block_array, extract_text, field, summarize
from logloom.functions.scalar import CONVERSATIONAL, STATE_LINES, live_heat
from logloom.operators.sequence import fold_state_runs
from logloom.operators.sessions import group_live, live_index_states, recent
from logloom.sources.scratch import written
from logloom.sources.tail import TailSource
from logloom.sources.transcripts import ROLLOUT_SOURCE, rollout_text


def tail(spark: SparkSession, pattern: str, **options: str) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", pattern).options(**options).load()


def to_events(lines: DataFrame) -> DataFrame:
    """path, offset, truncated, line, parsed, line_type, ts, role, text, summary; lines that are no JSON stay, as not parsed."""
    v = F.try_parse_json("line")
    row = lines.select("path", "offset", "truncated", "line", v.alias("v"))
    kind, rollout = field(F.col("v"), "$.type"), rollout_text(F.col("v"))
    talk = kind.isin(*CONVERSATIONAL)
    other = F.concat_ws(" · ", kind, field(F.col("v"), "$.subtype"))
    return row.select(
        "path", "offset", "truncated", "line", F.col("v").isNotNull().alias("parsed"), kind.alias("line_type"), field(F.col("v"), "$.timestamp").alias("ts"),
        F.when(talk, kind).otherwise(rollout["role"]).alias("role"),
        F.when(F.col("v").isNull(), F.col("line")).when(talk, extract_text(F.col("v"))).otherwise(F.coalesce(rollout["text"], other)).alias("text"),
        summarize(block_array(F.col("v"))).alias("summary"),
    )


def frames(rows: DataFrame, kind: str) -> DataFrame:
    """Each row as a JSON frame for listeners."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*rows.columns).alias("data"))).alias("frame"))


def counted(events: DataFrame, name: str = "tail") -> DataFrame:
    """events, whose lines, bytes, malformed lines and truncated files each trigger tells of (observedMetrics)."""
    size = F.octet_length("text") if "line" not in events.columns else F.octet_length("line")
    return events.observe(
        name, F.count("*").alias("lines"), F.coalesce(F.sum(size + 1), F.lit(0)).alias("bytes"), F.count_if(~F.col("parsed")).alias("malformed"),
        F.count_if(F.col("truncated")).alias("truncated"),
    )


def _offsets(told) -> dict:
    """The places of files, as a progress report has them: an object, or one that was made a string."""
    return told if isinstance(told, dict) else ast.literal_eval(told or "{}")


class Counters:
    """Adds up what a query's triggers tell, and what waits behind the last newline of each file."""

    def __init__(self, name: str = "tail"):
        self.name, self.total = name, {"lines": 0, "bytes": 0, "malformed": 0, "truncated": 0, "held_back": 0}
        self.seen = -1

    def add(self, query) -> None:
        for progress in query.recentProgress:
            told = (progress.observedMetrics or {}).get(self.name)
            if progress.batchId <= self.seen or told is None:
                continue
            self.seen = progress.batchId
            for k in ("lines", "bytes", "malformed", "truncated"):
                self.total[k] += told[k]
            ends = _offsets(progress.sources[0].endOffset)
            self.total["held_back"] = sum(max(0, os.path.getsize(p) - int(at)) for p, at in ends.items() if os.path.exists(p))

    def line(self) -> str:
        return " · ".join(f"{k.replace('_', ' ')} {v}" for k, v in self.total.items())


def watch(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = False, every: str = "1 second"):
    """Starts a query that hands every batch to sink; offsets are kept in the checkpoint. A batch is read once, however
    often the sink looks at it, so what is counted of it is counted once."""

    def once_read(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # as much as a trigger takes
        try:
            sink(kept, number)
        finally:
            kept.unpersist()

    writer = events.writeStream.foreachBatch(once_read).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class Presence(StatefulProcessor):
    """Who is there: state is a row a path (when it came and was last seen, in milliseconds), which a timer takes away
    when the path has not been seen for ``gone_after``. Goes by the stamps of the scans alone, so a replay tells the same."""

    def __init__(self, gone_after: int, quiet_until: int):
        self.gone_after, self.quiet_until = gone_after, quiet_until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stamps = sorted(int(t.value) // 1_000_000 for frame in rows for t in pd.to_datetime(frame["at"]))
        found = self.seen.get() if self.seen.exists() else None
        first, last = found if found else (None, None)
        told = []
        for at in stamps:
            if last is not None and at - last > self.gone_after:
                told.append((key[0], "left", last + self.gone_after))
                first = None
            if first is None:
                first = at
                if at > self.quiet_until:
                    told.append((key[0], "arrived", at))
            last = at if last is None else max(last, at)
        self.seen.update((first, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.gone_after)
        yield _presence_rows(told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = []
        if self.seen.exists():
            told.append((key[0], "left", self.seen.get()[1] + self.gone_after))
            self.seen.clear()
        yield _presence_rows(told)

    def close(self) -> None:
        pass


def _presence_rows(told: list[tuple[str, str, int]]) -> pd.DataFrame:
    paths, kinds, stamps = zip(*told) if told else ((), (), ())
    return pd.DataFrame({"path": pd.Series(paths, dtype=object), "kind": pd.Series(kinds, dtype=object), "at": pd.to_datetime(pd.Series(stamps, dtype="int64"), unit="ms")})


#: Timers and typed state need this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def presence(files: DataFrame, gone_after: str = "6 seconds", first_scan: str | None = None, late: str = "0 seconds") -> DataFrame:
    """files: a stream of (path, at timestamp), a row a path and scan. A row (path, kind, at) whenever a path arrives, or
    leaves because no scan has seen it for ``gone_after``. What was there up to first_scan (a stamp) does not arrive: a
    scan that begins finds everything new. The state is Spark's, a row a path that is there; nothing is kept here."""
    files.sparkSession.conf.set(*STATE_STORE)
    quiet = int(pd.Timestamp(first_scan).timestamp() * 1000) if first_scan else -1
    millis = int(pd.Timedelta(gone_after).total_seconds() * 1000)
    return (
        files.withWatermark("at", late).groupBy("path").transformWithStateInPandas(Presence(millis, quiet), "path string, kind string, at timestamp", "append", "EventTime")
    )


def arrivals(files: DataFrame, gone_after: str = "6 seconds", first_scan: str | None = None) -> DataFrame:
    """presence, of arrivals alone: (path, arrived_at)."""
    return presence(files, gone_after, first_scan).where("kind = 'arrived'").select("path", F.col("at").alias("arrived_at"))


def track_arrivals(live: DataFrame, known: DataFrame, previous: DataFrame, now: float, suppress: bool = False, flash: float = 6.0) -> DataFrame:
    """(file_path, arrived_at): what of live was not known before has arrived now, unless suppressed; earlier arrivals
    (previous) keep their time, and go when they are no longer live or ``flash`` seconds old."""
    fresh = F.when(F.col("k").isNull() & F.lit(not suppress), F.lit(float(now)))
    both = live.select("file_path").distinct().join(known.select("file_path", F.lit(1).alias("k")).distinct(), "file_path", "left").join(previous, "file_path", "left")
    return both.select("file_path", F.coalesce("arrived_at", fresh).alias("arrived_at")).where(F.lit(now) - F.col("arrived_at") < flash)


def fleet(transcripts: DataFrame, rollouts: DataFrame, names: DataFrame, now: int, window: int) -> DataFrame:
    """The files of both formats written within the window, the last written first: file_path, source, project (a known
    folder, else the directory's name), session_uuid, file_tier, agent_id, workflow_run_id, file_mtime, file_size, seconds,
    heat. transcripts: discover_files; rollouts: files with their headers; names: (dir_name, cwd)."""
    common = ["file_path", "source", "dir_name", "session_uuid", "file_tier", "agent_id", "workflow_run_id", "file_mtime", "file_size"]
    flow = F.lit(None).cast("string").alias("workflow_run_id")
    other = rollouts.select("*", F.lit(ROLLOUT_SOURCE).alias("source"), F.coalesce("cwd", F.lit("(unknown)")).alias("dir_name"), F.coalesce("nickname", "agent_role").alias("agent_id"), flow)
    both = transcripts.withColumn("source", F.lit("claude")).select(*common).unionByName(other.select(*common))
    seconds = F.greatest(F.lit(now) - F.col("file_mtime"), F.lit(0))
    own = recent(both, now, window).join(F.broadcast(names.select("dir_name", "cwd")), "dir_name", "left").withColumn("seconds", seconds)
    return own.select(*common[:2], F.coalesce("cwd", "dir_name").alias("project"), *common[3:], "seconds", live_heat(F.col("seconds")).alias("heat")).orderBy(
        F.col("file_mtime").desc(), "file_path"
    )


class LiveModel:
    """What a live view shows, brought up to date by ``tick``: the fleet, its groups and index states, what has just
    arrived, who entered and left the window, and the newest events, folded. What a tick needs of the one before it are
    two written tables, the live files with their arrivals and the newest events; no row of them is held here."""

    FLEET, EVENTS = "file_path string, arrived_at double", "id long, line_type string, ts string, role string, text string, summary string"

    def __init__(self, spark: SparkSession, keep: int = 150, expand: int = 20):
        self.spark, self.keep, self.expand = spark, keep, expand
        self.before = spark.createDataFrame([], self.FLEET)
        self.events = spark.createDataFrame([], self.EVENTS)
        self.window: int | None = None
        self.last_id = 0

    def tick(self, live: DataFrame, known: DataFrame, now: float, window: int, lines: DataFrame | None = None) -> dict:
        """live: fleet(); known: the sessions table; lines: new rows of to_events(). The first tick and one with
        another window show what is there without calling it new. sessions, groups, entered, left, arrived and folded
        are frames."""
        suppress, self.window = self.window != window, window
        last = self.before
        shown = live.join(live_index_states(live, known), "file_path").join(
            track_arrivals(live, last, last.where("arrived_at IS NOT NULL"), now, suppress), "file_path", "left"
        )
        shown = written(shown)
        self.before = written(shown.select("file_path", "arrived_at"))
        if lines is not None:
            newest = lines.orderBy(F.col("path").desc(), F.col("offset").desc()).limit(self.keep)
            order = Window.orderBy("path", "offset")  # as many rows as are kept
            own = newest.select((F.row_number().over(order) + self.last_id).cast("long").alias("id"), "line_type", "ts", "role", "text", "summary")
            self.events = written(self.events.unionByName(own).orderBy(F.col("id").desc()).limit(self.keep))
            self.last_id = self.events.agg(F.max("id")).first()[0] or self.last_id
        folded = fold_state_runs(self.events.withColumn("key", F.lit(0)), "key", "id", "line_type", "ts", STATE_LINES)
        return {
            "sessions": shown.orderBy(F.col("file_mtime").desc(), "file_path"), "groups": group_live(live, int(now)),
            "entered": shown.join(last, "file_path", "left_anti").select("file_path"), "left": last.join(shown, "file_path", "left_anti").select("file_path"),
            "arrived": shown.where("arrived_at IS NOT NULL").select("file_path", "arrived_at"), "folded": folded,
            "expand_from": self.last_id - self.expand, "status": f"{shown.count()} live",
        }


def wire_frames(fleet_rows: DataFrame, events: DataFrame, attached: str | None = None, history: DataFrame | None = None, errors: list[str] = ()) -> list[DataFrame]:
    """Frames of every kind that listeners are sent: fleet, events, attached, history and error."""
    spark = fleet_rows.sparkSession
    out = [frames(fleet_rows, "fleet"), frames(events, "events")]
    if attached is not None:
        out.append(frames(spark.createDataFrame([(attached,)], "path string"), "attached"))
    if history is not None:
        out.append(frames(history, "history"))
    if errors:
        out.append(frames(spark.createDataFrame([(e,) for e in errors], "message string"), "error"))
    return out


def event_windows(events: DataFrame, at: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: counts of line types by event-time window, late rows dropped by a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "line_type").agg(F.count("*").alias("lines"))
