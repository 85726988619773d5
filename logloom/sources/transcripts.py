"""JSONL transcripts: discovery of files in three tiers, per-file parsing, incremental import.

A scan lists metadata only (the binaryFile source without its content). Files are read line by line and may
be split; lines are numbered by their order in the file, after one shuffle by file. An import parses each
changed file once, into a staged table from which all that is stored is derived. Ids are hashes of natural
keys, so imports need no counter.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.blocks import extract_text, field
from logloom.functions.scalar import CONVERSATIONAL, diff_state, uuid_of_rollout
from logloom.operators.sessions import link_parents, link_rollout_parents
from logloom.sources import ranges
from logloom.sources.lines import as_object, parsed_lines, running

#: Paths of one read: their list is held by the driver, as is that of any directory that Spark reads.
READ_FILES = 5000


def _listing(spark: SparkSession, root: str, pattern: str, modified_after: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(root).select(
        F.col("path").alias("file_path"), F.unix_timestamp("modificationTime").alias("file_mtime"), F.col("length").alias("file_size")
    )


def _resolved(spark: SparkSession, root: str) -> str:
    """The root as a listing spells it, without a last slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def discover_files(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """file_path, file_mtime, file_size, dir_name, file_tier, session_uuid, agent_id, workflow_run_id of every
    transcript below root; other depths and workflow journals are left out, and so are files without a byte yet."""
    parts = F.split(F.substring(F.col("file_path"), len(_resolved(spark, root)) + 1, 1 << 30), "/")
    depth = F.size(parts) - 1
    is_flow = (depth == 6) & (parts[3] == "subagents") & (parts[4] == "workflows") & parts[5].startswith("wf_") & (parts[6] != "journal.jsonl")
    tier = F.when(depth == 2, "session").when((depth == 4) & (parts[3] == "subagents"), "subagent").when(is_flow, "workflow_agent")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    out = _listing(spark, root, "*.jsonl", modified_after).select("*", parts.alias("p"), tier.alias("file_tier"), stem.alias("stem")).where("file_tier IS NOT NULL")
    return out.select(
        "file_path", "file_mtime", "file_size", F.col("p")[1].alias("dir_name"), "file_tier",
        F.when(F.col("file_tier") == "session", F.col("stem")).otherwise(F.col("p")[2]).alias("session_uuid"),
        F.when(F.col("file_tier") == "subagent", F.col("stem")).when(F.col("file_tier") == "workflow_agent", F.expr("substr(stem, 7)")).alias("agent_id"),
        F.when(F.col("file_tier") == "workflow_agent", F.get("p", F.lit(5))).alias("workflow_run_id"),
    )


def parse_sessions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A row a non-blank line: file_path, seq (blank lines don't count), line_type, ts, cwd, role, text; line_type is
    null for lines that are no JSON object."""
    lines = parsed_lines(spark, paths).where("trim(raw) <> ''").withColumn("seq", F.col("line").cast("long"))
    kind = field(F.col("v"), "$.type")
    talk = kind.isin(*CONVERSATIONAL)
    return lines.select(
        "file_path", "seq", F.when(F.col("v").isNotNull(), F.coalesce(kind, F.lit("(none)"))).alias("line_type"),
        field(F.col("v"), "$.timestamp").alias("ts"), field(F.col("v"), "$.cwd").alias("cwd"),
        F.when(talk, kind).alias("role"), F.when(talk, extract_text(F.col("v"))).alias("text"),
    )


def events_of(lines: DataFrame) -> DataFrame:
    return lines.where("role IS NOT NULL AND text <> ''").select("file_path", "seq", "role", "ts", "text")


def session_summaries(lines: DataFrame) -> DataFrame:
    """A row a file: counts, first and last stamp in line order, first cwd, first words of the user."""

    def first(column: str, condition: Column) -> Column:
        return F.min_by(F.when(condition, F.col(column)), F.when(condition, F.col("seq")))

    has_ts = F.col("ts").isNotNull()
    said = (F.col("role") == "user") & (F.trim("text") != "")
    return lines.groupBy("file_path").agg(
        F.count("*").alias("line_count"),
        F.count("role").alias("event_count"),
        first("ts", has_ts).alias("started_at"),
        F.max_by(F.when(has_ts, F.col("ts")), F.when(has_ts, F.col("seq"))).alias("ended_at"),
        first("cwd", F.col("cwd").isNotNull()).alias("cwd"),
        F.substring(first("text", said), 1, 200).alias("description"),
    )


#: How far into a file its working folder and its header are looked for.
CWD_BYTES, CWD_LINES = 64 << 10, 4
HEADER_BYTES, HEADER_LINES = 128 << 10, 8


def _first_lines(files: DataFrame, most: int, lines: int) -> DataFrame:
    """(file_path, pos, v) of the files' first lines that are JSON objects, read from their first bytes alone."""
    return ranges.heads(files, most, lines).select("file_path", "pos", as_object().alias("v")).where("v IS NOT NULL")


def first_cwd(files: DataFrame) -> DataFrame:
    """(file_path, cwd): the working folder that one of the first lines of files (file_path) names."""
    cwd = F.nullif(field(F.col("v"), "$.cwd"), F.lit(""))
    found = _first_lines(files, CWD_BYTES, CWD_LINES).select("file_path", "pos", cwd.alias("cwd")).where("cwd IS NOT NULL")
    return found.groupBy("file_path").agg(F.min_by("cwd", "pos").alias("cwd"))


def probe_cwd(scan: DataFrame) -> DataFrame:
    """project_scan's rows and the folder that each one's sample file names."""
    probed = first_cwd(scan.select(F.col("sample_path").alias("file_path")))
    return scan.join(probed.withColumnRenamed("file_path", "sample_path"), "sample_path", "left")


# --- rollout files: another product's format ---------------------------------------------------------------


def rollout_files(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    return _listing(spark, root, "rollout-*.jsonl", modified_after)


def _header(v: Column) -> Column:
    get = lambda path: field(v, f"$.payload.{path}")
    return F.struct(
        get("id").alias("uuid"), get("cwd").alias("cwd"), get("agent_nickname").alias("nickname"), get("agent_role").alias("agent_role"),
        F.coalesce(get("parent_thread_id"), get("forked_from_id")).alias("parent_uuid"),
        (F.coalesce(get("thread_source") == "subagent", F.lit(False)) | get("parent_thread_id").isNotNull()).alias("is_subagent"),
    )


def probe_headers(files: DataFrame) -> DataFrame:
    """rollout_headers of files (file_path), of which the first bytes alone are read."""
    meta = F.when(field(F.col("v"), "$.type") == "session_meta", _header(F.col("v")))
    found = _first_lines(files, HEADER_BYTES, HEADER_LINES).select("file_path", "pos", meta.alias("header")).where("header IS NOT NULL")
    empty = files.select("file_path", F.lit(HEADER_LINES).cast("long").alias("pos"), F.lit(None).cast(found.schema["header"].dataType).alias("header"))
    return rollout_headers(found.unionByName(empty))


def rollout_headers(lines: DataFrame) -> DataFrame:
    """Of the first session_meta among a file's first lines (parse_rollouts): uuid (else from the name), cwd, parent, file_tier."""
    first = lines.groupBy("file_path").agg(F.min_by("header", F.when(F.col("header").isNotNull(), F.col("pos"))).alias("h"))
    return first.select(
        "file_path", F.coalesce("h.uuid", uuid_of_rollout(F.element_at(F.split("file_path", "/"), -1))).alias("session_uuid"), "h.cwd", "h.nickname",
        "h.agent_role", "h.parent_uuid", F.when(F.col("h.is_subagent"), "subagent").otherwise("session").alias("file_tier"),
    )


# Calls and their outputs among a rollout's items.
CALLS = ("custom_tool_call", "function_call")
OUTPUTS = ("custom_tool_call_output", "function_call_output")


def _flat(v: Column, path: str) -> Column:
    """A text, or the texts of blocks that are not empty, a line each; '' for anything else."""
    blocks = F.transform(F.try_variant_get(v, path, "array<struct<text:string>>"), lambda b: b["text"])
    texts = F.filter(blocks, lambda t: t.isNotNull() & (t != ""))
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.coalesce(F.array_join(texts, "\n"), F.when(is_text, field(v, path)), F.lit(""))


def rollout_text(v: Column) -> Column:
    """struct(role, text) of a response item: messages, calls and their outputs; null for the rest."""
    kind, get = field(v, "$.payload.type"), lambda p: field(v, f"$.payload.{p}")
    said = F.concat(_flat(v, "$.payload.input"), _flat(v, "$.payload.arguments"))
    call = F.concat_ws(" · ", F.coalesce(get("name"), F.lit("tool")), F.nullif(said, F.lit("")))
    found = (
        F.when(kind == "message", F.struct(F.coalesce(get("role"), F.lit("assistant")).alias("role"), _flat(v, "$.payload.content").alias("text")))
        .when(kind.isin(*CALLS), F.struct(F.lit("tool_use").alias("role"), call.alias("text")))
        .when(kind.isin(*OUTPUTS), F.struct(F.lit("tool_result").alias("role"), _flat(v, "$.payload.output").alias("text")))
    )
    return F.when((field(v, "$.type") == "response_item") & (found["text"] != ""), found)


def parse_rollouts(spark: SparkSession, paths: list[str] | str, head: int = 8) -> DataFrame:
    """A row a line (blank ones too): file_path, pos, line_type, ts, role, text, header (of a session_meta among the
    first lines) and seq, which counts lines with text alone. An unfinished last line tells no stamp and is not malformed."""
    lines = parsed_lines(spark, paths).select("*", rollout_text(F.col("v")).alias("t"))
    lines = running(lines, seq=F.col("t").isNotNull().cast("long"))
    malformed = F.col("v").isNull() & (F.trim("raw") != "") & ~F.col("last")
    kind = F.concat_ws("/", F.coalesce(field(F.col("v"), "$.type"), F.lit("(no type)")), field(F.col("v"), "$.payload.type"))
    meta = (F.col("pos") < head) & (field(F.col("v"), "$.type") == "session_meta")
    return lines.select(
        "file_path", "pos", F.when(malformed, "(malformed)").when(F.col("v").isNotNull(), kind).alias("line_type"),
        F.when(~F.col("last"), field(F.col("v"), "$.timestamp")).alias("ts"), F.col("t.role").alias("role"), F.col("t.text").alias("text"),
        F.when(F.col("t").isNotNull(), F.col("seq")).alias("seq"), F.when(meta, _header(F.col("v"))).alias("header"),
    )


def rollout_summaries(lines: DataFrame) -> DataFrame:
    has_ts = F.col("ts").isNotNull()
    said = F.col("text").isNotNull() & (F.col("role") != "developer")
    return lines.groupBy("file_path").agg(
        F.count("*").alias("line_count"),
        F.count("text").alias("event_count"),
        F.min_by(F.when(has_ts, F.col("ts")), F.when(has_ts, F.col("pos"))).alias("started_at"),
        F.max_by(F.when(has_ts, F.col("ts")), F.when(has_ts, F.col("pos"))).alias("ended_at"),
        F.substring(F.substring_index(F.min_by(F.when(said, F.col("text")), F.when(said, F.col("pos"))), "\n", 1), 1, 200).alias("description"),
    )


def rollout_scan(files: DataFrame, headers: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row: files, bytes, with a known folder, with a parent; the folders with most files)."""
    both = files.join(headers, "file_path", "left")
    totals = both.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.count("cwd").alias("with_cwd"), F.count("parent_uuid").alias("with_parent"))
    folders = both.groupBy(F.coalesce("cwd", F.lit("(unknown)")).alias("project")).agg(F.count("*").alias("files"))
    return totals, folders.orderBy(F.col("files").desc(), "project").limit(top)


# --- incremental import ------------------------------------------------------------------------------------


@dataclass
class ImportResult:
    """What an import adds to the stored tables: its rows replace those of the same id."""

    sessions: DataFrame
    projects: DataFrame
    type_counts: DataFrame
    events: DataFrame
    counts: dict[str, int]


def session_id(path: Column) -> Column:
    return F.xxhash64(path)


def _staged(spark: SparkSession, todo: DataFrame, parse, staging: str) -> DataFrame:
    """The lines of the files to do, each parsed once and written to the staging folder, some thousand files a job."""
    paths, schema = todo.select("file_path").toLocalIterator(), None
    while group := [r["file_path"] for r in islice(paths, READ_FILES)]:
        lines = parse(spark, group)
        lines.write.mode("append").parquet(staging)
        schema = lines.schema
    return spark.read.schema(schema).parquet(staging) if schema else None


def _states(found: DataFrame, known: DataFrame, with_status: bool) -> DataFrame:
    kept = [F.col(c).alias(f"k_{c}") for c in ("file_mtime", "file_size", "import_status", *SUMMARY)]
    k = known.select("file_path", *kept)
    status = F.col("k_import_status") if with_status else F.lit("imported")
    return found.join(k, "file_path", "left").withColumn("state", diff_state(F.col("k_file_mtime"), F.col("k_file_size"), status, F.col("file_mtime"), F.col("file_size")))


#: What a failed import leaves as it was.
SUMMARY = ("line_count", "event_count", "started_at", "ended_at", "description")


def _result(work: DataFrame, todo: DataFrame, lines: DataFrame | None, summary, now: str, source: str | None, force: bool) -> ImportResult:
    """todo: a row a file with its names, project (dir_name) and cwd."""
    spark = work.sparkSession
    counts = {r["state"]: r["n"] for r in work.groupBy("state").agg(F.count("*").alias("n")).collect()}  # three rows
    if lines is None:
        lines = spark.createDataFrame([], "file_path string, seq long, pos long, line_type string, ts string, cwd string, role string, text string")
    own = summary(lines)
    good = lines.where("line_type IS NOT NULL AND line_type <> '(malformed)'").select("file_path").distinct().withColumn("ok", F.lit(True))
    joined = todo.join(own.drop("cwd"), "file_path", "left").join(good, "file_path", "left")
    status = F.when(F.col("ok") | (F.col("file_size") == 0), "imported").otherwise("failed")
    failed = status == "failed"
    kept = [F.when(failed, F.col(f"k_{c}")).otherwise(F.coalesce(c, F.lit(0).cast("long")) if c.endswith("count") else F.col(c)).alias(c) for c in SUMMARY]
    sessions = joined.select(
        session_id(F.col("file_path")).alias("id"), F.xxhash64("dir_name").alias("project_id"), "session_uuid", "file_path", "file_tier", "workflow_run_id",
        "agent_id", F.lit(None).cast("long").alias("parent_session_id"), F.lit(source).cast("string").alias("source"), "file_mtime", "file_size",
        F.lit(now).alias("imported_at"), status.alias("import_status"), F.when(failed, "no JSON object in the file").alias("import_error"), *kept,
    )
    n_failed = sessions.where("import_status = 'failed'").count()
    tables = {"files_scanned": sum(counts.values()), "files_new": counts.get("new", 0), "files_changed": counts.get("changed", 0), "files_skipped": 0 if force else counts.get("unchanged", 0), "files_failed": n_failed}
    projects = todo.groupBy(F.xxhash64("dir_name").alias("id"), "dir_name").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("file_path"))).alias("cwd")).select(
        "id", "dir_name", "cwd", F.lit(now).alias("first_seen_at"), F.lit(now).alias("last_seen_at")
    )
    types = lines.where("line_type IS NOT NULL").groupBy(session_id(F.col("file_path")).alias("session_id"), "line_type").agg(F.count("*").alias("count"))
    events = events_of(lines).select(session_id(F.col("file_path")).alias("session_id"), "seq", "role", "ts", "text")
    return ImportResult(sessions, projects, types, events, tables)


def incremental_import(
    spark: SparkSession, root: str, known: DataFrame, now: str, staging: str, only: list[str] | None = None, since: int | None = None, force: bool = False, source: str | None = None
) -> ImportResult:
    """Parses what is new or changed below root against the known sessions, into the staging folder. The result's
    frames replace the rows of their session. A file without one JSON object is failed, and a file that failed
    keeps what was known of it before."""
    found = discover_files(spark, root)
    if only:
        found = found.where(F.col("dir_name").isin(*only))
    if since is not None:
        found = found.where(F.col("file_mtime") >= since)
    work = _states(found, known, True)
    todo = work if force else work.where("state <> 'unchanged'")
    lines = _staged(spark, todo, parse_sessions, staging)
    if lines is not None:
        todo = todo.join(session_summaries(lines).select("file_path", "cwd"), "file_path", "left")
    else:
        todo = todo.withColumn("cwd", F.lit(None).cast("string"))
    out = _result(work, todo, lines, session_summaries, now, source, force)
    out.sessions = link_parents(out.sessions)
    return out


def rollout_import(spark: SparkSession, root: str, known: DataFrame, now: str, staging: str) -> ImportResult:
    """The same for rollout files: a project is the folder a session worked in, the tier and the parent are told by
    the header; files that failed before but have not changed are left alone."""
    work = _states(rollout_files(spark, root), known, False)
    todo = work.where("state <> 'unchanged'")
    lines = _staged(spark, todo, parse_rollouts, staging)
    if lines is None:
        empty = todo.select("*", *(F.lit(None).cast("string").alias(c) for c in ("session_uuid", "dir_name", "cwd", "file_tier", "workflow_run_id", "agent_id")))
        return _result(work, empty.where("false"), None, rollout_summaries, now, ROLLOUT_SOURCE, False)
    heads = rollout_headers(lines)
    named = todo.join(heads, "file_path", "left").withColumn("dir_name", F.coalesce("cwd", F.lit("(unknown)")))
    named = named.select("*", F.lit(None).cast("string").alias("workflow_run_id"), F.coalesce("nickname", "agent_role").alias("agent_id"))
    out = _result(work, named, lines, rollout_summaries, now, ROLLOUT_SOURCE, False)
    parents = heads.select("file_path", "parent_uuid")
    out.sessions = link_rollout_parents(out.sessions.join(parents, "file_path", "left"), known)
    return out


#: Fixed value: how rows of the rollout format are told from the others.
ROLLOUT_SOURCE = "codex"


def replace_by_key(stored: DataFrame, fresh: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """stored without the rows of fresh's (or keys') keys, and fresh."""
    gone = (keys if keys is not None else fresh).select(key).distinct()
    return stored.join(gone, key, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def upsert_projects(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The first known cwd and sighting stay, the last sighting moves."""
    old = stored.select("dir_name", *(F.col(c).alias(f"o_{c}") for c in ("id", "cwd", "first_seen_at", "last_seen_at")))
    both = old.join(fresh, "dir_name", "full_outer")
    return both.select(
        F.coalesce("o_id", "id").alias("id"), "dir_name", F.coalesce("o_cwd", "cwd").alias("cwd"),
        F.coalesce("o_first_seen_at", "first_seen_at").alias("first_seen_at"), F.coalesce("last_seen_at", "o_last_seen_at").alias("last_seen_at"),
    )
