"""Text reports over the index: what an import would do, lists, status, scans, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalar import compact_stamp, human_bytes, one_line, utc_stamp
from logloom.operators import sessions as ops


def table(rows: DataFrame, limit: int = 200) -> list[str]:
    """A frame's first rows as aligned columns under their names."""
    found = rows.limit(limit).collect()
    cells = [rows.columns, *([("—" if x is None else str(x)).replace("\n", " ") for x in r] for r in found)]
    width = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    return ["  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in cells]


def diff(known: DataFrame, disk: DataFrame, root: str) -> list[str]:
    """What an import would do; nothing is written."""
    of = {r["state"]: r for r in ops.diff_totals(ops.manifest_diff(known, disk)).collect()}  # four rows
    n = lambda s: of[s]["files"] if s in of else 0
    mb = lambda s: (of[s]["bytes"] or 0) // 1_000_000 if s in of else 0
    out = [f"scanned   {n('new') + n('changed') + n('unchanged')} files under {root}"]
    out += [f"{s:<9} {n(s)}  ({mb(s)} MB)" for s in ("new", "changed")] + [f"unchanged {n('unchanged')}"]
    return out + ([f"in db but no longer on disk: {n('gone')}"] if n("gone") else [])


def listing(sessions: DataFrame, projects: DataFrame, sort: str = "updated", descending: bool | None = None, tier: str | None = None, limit: int = 40) -> list[str]:
    rows = ops.list_sessions(sessions, projects, sort, descending, tier, limit=limit)
    shown = rows.select(
        F.col("file_tier").alias("tier"), "project", F.col("event_count").alias("events"), F.col("line_count").alias("lines"), F.expr("file_size div 1000").alias("size"),
        F.coalesce(F.replace(F.substring("started_at", 1, 16), F.lit("T"), F.lit(" ")), F.lit("—")).alias("started utc"),
        utc_stamp(F.col("file_mtime"), "yyyy-MM-dd HH:mm").alias("updated utc"), one_line(F.coalesce("description", "session_uuid"), 60).alias("description"),
    )
    out = table(shown, limit)
    return [*out, f"{len(out) - 1} rows · sort {sort} · tier {tier or 'all'} · limit {limit}"]


def status(sessions: DataFrame, projects: DataFrame) -> list[str]:
    by_tier = ops.tier_status_stats(sessions).orderBy("file_tier", "import_status")
    by_source = ops.count_and_size(sessions.withColumn("source", F.coalesce("source", F.lit("claude"))), "source", "file_tier").orderBy("source", "file_tier")
    span = sessions.agg(F.min("started_at").alias("first"), F.max("ended_at").alias("last"))
    return [*table(ops.overview(sessions, projects)), "", *table(by_tier), "", *table(by_source), "", *table(span)]


def scan(files: DataFrame) -> list[str]:
    """files: with their state, as project_scan wants them."""
    each = ops.project_scan(files)
    return [*table(each.select("files", human_bytes(F.col("bytes")).alias("size"), "new", "changed", "dir_name"), 40), "", *table(ops.scan_totals(each))]


def searches(log: DataFrame, newest: int = 50) -> list[str]:
    flag = F.when(F.col("hits") == 0, "EMPTY").when((F.col("hits") > 1) & (F.abs("top_score") > 0) & (F.try_divide("score_spread", F.abs("top_score")) < 0.05), "FLAT").otherwise("")
    rows = log.orderBy(F.col("id").desc()).limit(newest)
    shown = rows.select(compact_stamp(F.col("ts")).alias("at"), "engine", "hits", "ms", flag.alias("note"), one_line(F.col("query"), 60).alias("query"))
    return [*table(shown, newest), "", *table(ops.log_digest(log, newest)), "", *table(ops.empty_searches(log, 10))]


def runs(log: DataFrame, limit: int = 20) -> list[str]:
    return table(ops.newest_runs(log, limit), limit)
