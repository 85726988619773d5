"""Relational operators over sessions, projects, runs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalar import diff_state, fold_ascii, index_state, live_heat, tier_rank

#: Allowed sort keys: column, and whether it is text (text is compared without ASCII case, ascending by default).
SORT_KEYS: dict[str, tuple[str, bool]] = {
    "updated": ("file_mtime", False),
    "started": ("started_at", False),
    "events": ("event_count", False),
    "lines": ("line_count", False),
    "size": ("file_size", False),
    "project": ("project", True),
    "description": ("description", True),
    "tier": ("file_tier", True),
}


def with_projects(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """sessions with dir_name, cwd and project (cwd if known)."""
    names = projects.select(F.col("id").alias("project_id"), "dir_name", "cwd")
    return sessions.join(names, "project_id").withColumn("project", F.coalesce("cwd", "dir_name"))


def sort_columns(key: str, descending: bool | None = None) -> list[Column]:
    """Order by a key; ties by id, newest first, in both directions. Unknown keys are refused."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key!r}; known: {', '.join(sorted(SORT_KEYS))}")
    name, text = SORT_KEYS[key]
    c = fold_ascii(F.col(name)) if text else F.col(name)
    down = not text if descending is None else descending
    return [c.desc_nulls_last() if down else c.asc_nulls_first(), F.col("id").desc()]


def list_sessions(
    sessions: DataFrame, projects: DataFrame, sort: str = "updated", descending: bool | None = None, tier: str | None = None, since: int | None = None, limit: int = 40
) -> DataFrame:
    out = with_projects(sessions, projects)
    if tier is not None:
        out = out.where(F.col("file_tier") == tier)
    if since is not None:
        out = out.where(F.col("file_mtime") >= since)
    shown = out.select(
        "id", "session_uuid", "project", "file_tier", F.coalesce("source", F.lit("claude")).alias("source"), "file_mtime", "file_size",
        F.coalesce("line_count", F.lit(0).cast("long")).alias("line_count"), F.coalesce("event_count", F.lit(0).cast("long")).alias("event_count"), "started_at", "description",
    )
    return shown.orderBy(*sort_columns(sort, descending)).limit(limit)


def by_uuid_prefix(sessions: DataFrame, prefix: str, limit: int = 200) -> DataFrame:
    return sessions.where(F.col("session_uuid").ilike(f"{prefix}%")).orderBy("id").limit(limit)


def resolve_distinct(sessions: DataFrame) -> DataFrame:
    """One row a uuid: a session before its agents, then the one with most events. by_uuid_prefix bounds its input."""
    order = Window.partitionBy("session_uuid").orderBy(tier_rank(F.col("file_tier")), F.col("event_count").desc_nulls_last(), "id")
    return sessions.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def read_page(events: DataFrame, session_id: int, start: int = 0, limit: int = 30) -> DataFrame:
    return events.where((F.col("session_id") == session_id) & (F.col("seq") >= start)).orderBy("seq").limit(limit)


def read_context(events: DataFrame, session_id: int, seq: int, before: int = 4, after: int = 6) -> DataFrame:
    """Lines around one, by number: gaps make it fewer rows."""
    return events.where((F.col("session_id") == session_id) & F.col("seq").between(max(0, seq - before), seq + after)).orderBy("seq")


def count_and_size(sessions: DataFrame, *keys: str) -> DataFrame:
    return sessions.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.sum("event_count").alias("events"))


def tier_status_stats(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("file_tier", "import_status").agg(
        F.count("*").alias("files"), F.expr("sum(file_size) div 1000000").alias("mb"), F.sum("line_count").alias("lines")
    )


def overview(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """The whole index in one row: sessions, projects, imported and failed ones, bytes of the files it covers, their
    events and lines, and when the first project was seen. One aggregate a table, joined as single rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("import_status") == "imported").alias("imported"),
        F.count_if(F.col("import_status") == "failed").alias("failed"),
        total("file_size").alias("bytes"),
        total("event_count").alias("events"),
        total("line_count").alias("lines"),
    )
    return one.join(F.broadcast(projects.agg(F.count("*").alias("projects"), F.min("first_seen_at").alias("first_seen_at"))))


def project_shape(sessions: DataFrame, projects: DataFrame, limit: int = 15) -> DataFrame:
    tiers = {t: F.count_if(F.col("file_tier") == t).alias(t) for t in ("session", "subagent", "workflow_agent")}
    return (
        with_projects(sessions, projects)
        .groupBy("project")
        .agg(*tiers.values(), F.round(F.sum("file_size") / 1048576, 1).alias("mb"), F.sum("event_count").alias("events"))
        .orderBy(F.col("mb").desc(), "project")
        .limit(limit)
    )


def biggest(sessions: DataFrame, projects: DataFrame, tier: str, limit: int = 10) -> DataFrame:
    return with_projects(sessions, projects).where(F.col("file_tier") == tier).select("id", "project", "file_size").orderBy(F.col("file_size").desc(), "id").limit(limit)


def type_histogram(lines: DataFrame) -> DataFrame:
    return lines.groupBy("session_id", "line_type").agg(F.count("*").alias("count"))


def corpus_histogram(type_counts: DataFrame) -> DataFrame:
    return type_counts.groupBy("line_type").agg(F.sum("count").alias("lines"), F.countDistinct("session_id").alias("sessions"))


def first_last(lines: DataFrame, key: str, order: str, ts: str) -> DataFrame:
    """First and last stamp in line order (not the least and greatest), and the number of lines."""
    seen = F.col(ts).isNotNull()
    return lines.groupBy(key).agg(
        F.min_by(F.when(seen, F.col(ts)), F.when(seen, F.col(order))).alias("started_at"),
        F.max_by(F.when(seen, F.col(ts)), F.when(seen, F.col(order))).alias("ended_at"),
        F.count("*").alias("line_count"),
    )


def project_scan(files: DataFrame) -> DataFrame:
    """files: (dir_name, file_path, file_tier, file_size, state). A row a project, most files first."""
    order = F.struct(tier_rank(F.col("file_tier")), "file_path")
    return (
        files.groupBy("dir_name")
        .agg(
            F.count("*").alias("files"),
            F.sum("file_size").alias("bytes"),
            F.count_if(F.col("state") == "new").alias("new"),
            F.count_if(F.col("state") == "changed").alias("changed"),
            F.min_by("file_path", order).alias("sample_path"),
        )
        .orderBy(F.col("files").desc(), "dir_name")
    )


def scan_states(known: DataFrame, disk: DataFrame) -> DataFrame:
    """disk (file_path, file_mtime, file_size, ...) with state as a scan tells it: new, changed where stamp or size differ,
    else unchanged; whether an import failed makes no difference."""
    k = known.select("file_path", F.col("file_mtime").alias("__m"), F.col("file_size").alias("__s"))
    same = (F.col("__m") == F.col("file_mtime")) & (F.col("__s") == F.col("file_size"))
    state = F.when(F.col("__m").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return disk.join(k, "file_path", "left").withColumn("state", state).drop("__m", "__s")


def scan_totals(projects: DataFrame) -> DataFrame:
    return projects.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.col("new") + F.col("changed")).alias("pending"))


def manifest_diff(known: DataFrame, disk: DataFrame) -> DataFrame:
    """file_path, file_size and state (new, changed, unchanged, gone) of every path on either side."""
    k = known.select(F.col("file_path"), F.col("file_mtime").alias("km"), F.col("file_size").alias("ks"), F.col("import_status").alias("kst"))
    d = disk.select(F.col("file_path"), F.col("file_mtime").alias("dm"), F.col("file_size").alias("ds"))
    state = F.when(F.col("dm").isNull(), "gone").otherwise(diff_state(F.col("km"), F.col("ks"), F.col("kst"), F.col("dm"), F.col("ds")))
    return k.join(d, "file_path", "full_outer").select("file_path", F.coalesce("ds", "ks").alias("file_size"), state.alias("state"))


def diff_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("state").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def gone(known: DataFrame, disk: DataFrame) -> DataFrame:
    return known.select("file_path").distinct().join(disk.select("file_path"), "file_path", "left_anti")


def live_index_states(live: DataFrame, known: DataFrame) -> DataFrame:
    k = known.select("file_path", F.col("file_mtime").alias("km"), F.col("file_size").alias("ks"), F.col("import_status").alias("kst"))
    return live.join(k, "file_path", "left").select("file_path", index_state(F.col("km"), F.col("ks"), F.col("kst"), F.col("file_mtime"), F.col("file_size")).alias("state"))


def link_parents(sessions: DataFrame, source: str = "claude") -> DataFrame:
    """Agents get the smallest id of the main session of their uuid and project, where they have no parent yet."""
    mains = (
        sessions.where((F.col("file_tier") == "session") & (F.coalesce("source", F.lit("claude")) == source))
        .groupBy("session_uuid", "project_id")
        .agg(F.min("id").alias("__parent"))
    )
    agent = (F.col("file_tier") != "session") & (F.coalesce("source", F.lit("claude")) == source)
    parent = F.when(agent, F.coalesce("parent_session_id", "__parent")).otherwise(F.col("parent_session_id"))
    return sessions.join(mains, ["session_uuid", "project_id"], "left").withColumn("parent_session_id", parent).drop("__parent")


def link_rollout_parents(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """sessions with a parent_uuid: the smallest id of that uuid among them and the known ones becomes their parent."""
    every = sessions.select("session_uuid", "id").unionByName(known.select("session_uuid", "id"))
    owners = every.groupBy(F.col("session_uuid").alias("parent_uuid")).agg(F.min("id").alias("__parent"))
    linked = sessions.join(owners, "parent_uuid", "left")
    return linked.withColumn("parent_session_id", F.coalesce("__parent", "parent_session_id")).drop("__parent", "parent_uuid")


def group_live(live: DataFrame, now: int) -> DataFrame:
    """live: (session_uuid, file_path, file_tier, agent_id, file_mtime, file_size). A row a uuid: its parent,
    children in order, totals and heat; active groups first."""
    main = F.col("file_tier") == "session"
    child = F.when(~main, F.struct(F.coalesce("agent_id", "file_path").alias("k"), "file_path"))
    grouped = live.groupBy("session_uuid").agg(
        F.min(F.when(main, F.col("file_path"))).alias("parent_path"),
        F.array_sort(F.collect_list(child)).alias("c"),  # agents of one session
        F.max("file_mtime").alias("newest"),
        F.sum("file_size").alias("bytes"),
        F.count("*").alias("files"),
    )
    heat = live_heat(F.lit(now) - F.col("newest"))
    return grouped.select("session_uuid", "parent_path", F.transform("c", lambda x: x["file_path"]).alias("children"), "newest", "bytes", "files", heat.alias("heat")).orderBy(
        F.when(F.col("heat") == "cool", 1).otherwise(0), "session_uuid"
    )


def live_filter(live: DataFrame, text: str) -> DataFrame:
    """Files whose project, uuid, agent or run holds the text; a hit on a parent keeps its children."""
    names = F.concat_ws("\n", "project", "session_uuid", "agent_id", "workflow_run_id")
    hit = F.lower(names).contains(text.lower())
    main = F.col("file_tier") == "session"
    parent = F.max(F.when(main & hit, 1).otherwise(0)).over(Window.partitionBy("session_uuid"))
    some = F.max(F.when(hit, 1).otherwise(0)).over(Window.partitionBy("session_uuid"))
    return live.select("*", hit.alias("__h"), parent.alias("__p"), some.alias("__s")).where((F.col("__p") == 1) | F.col("__h") | (main & (F.col("__s") == 1))).drop("__h", "__p", "__s")


def project_buckets(groups: DataFrame, rank: str) -> DataFrame:
    """groups in an order (rank) to projects in order of first appearance."""
    return groups.groupBy("project").agg(
        F.min(rank).alias("position"),
        F.max("newest").alias("newest"),
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("sessions"),
        F.sum(F.col("files") - 1).alias("agents"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def recent(files: DataFrame, now: int, window: int) -> DataFrame:
    return files.where(F.col("file_mtime") >= now - window)


def empty_searches(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.where("hits = 0").groupBy("query", "engine").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "query", "engine").limit(limit)


def log_digest(log: DataFrame, newest: int = 50) -> DataFrame:
    """Of the newest rows: how many, how many empty, how many flat."""
    flat = (F.col("hits") > 1) & (F.abs("top_score") > 0) & (F.try_divide("score_spread", F.abs("top_score")) < 0.05)
    last = log.orderBy(F.col("id").desc()).limit(newest)
    return last.agg(F.count("*").alias("rows"), F.count_if(F.col("hits") == 0).alias("empty"), F.count_if(F.coalesce(flat, F.lit(False))).alias("flat"))


def newest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The last runs, and whether each broke off."""
    return runs.withColumn("interrupted", F.col("finished_at").isNull()).orderBy(F.col("id").desc()).limit(limit)


def by_id(sessions: DataFrame, projects: DataFrame, session_id: int) -> DataFrame:
    """One session as the list shows it, whatever the list's filters are."""
    return list_sessions(sessions.where(F.col("id") == session_id), projects)


def id_of_path(sessions: DataFrame, path: str) -> DataFrame:
    return sessions.where(F.col("file_path") == path).select("id").limit(1)


def recent_list(live: DataFrame, now: int, window: int) -> DataFrame:
    """Files written within the window, the last written first."""
    return recent(live, now, window).orderBy(F.col("file_mtime").desc(), "file_path")


def database_age(sessions: DataFrame | None) -> tuple[str, int]:
    """missing, empty or populated, and the number of sessions."""
    n = 0 if sessions is None else sessions.count()
    return ("missing" if sessions is None else "populated" if n else "empty"), n
