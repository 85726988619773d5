"""The driver's tables in the shape of transcripts: which columns stand for which."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import textindex
from logloom.sources.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


_indexes: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(postings, indexed) of all events: an index that is written once an application and then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        own = events(spark, sf_dir)
        _indexes[key] = written(textindex.postings(own, 1), "kind", "part"), written(textindex.indexed(own, 1))
    return _indexes[key]


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("-home-"), name).alias("dir_name"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("/home/"), F.lower("c_mktsegment"), F.lit("/"), name)).alias("cwd"),
        F.concat(F.lit("2024-"), F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0"), F.lit("-01")).alias("first_seen_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("project_id"),
        F.md5((key - key % 3).cast("string").cast("binary")).alias("session_uuid"),
        F.concat(F.lit("/corpus/"), F.col("o_custkey").cast("string"), F.lit("/"), key.cast("string"), F.lit(".jsonl")).alias("file_path"),
        F.when(F.col("o_orderstatus") == "F", "session").when(F.col("o_orderstatus") == "O", "subagent").otherwise("workflow_agent").alias("file_tier"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("agent-a"), key.cast("string"))).alias("agent_id"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("wf_"), (key % 100).cast("string"))).alias("workflow_run_id"),
        F.lit(None).cast("long").alias("parent_session_id"),
        F.when(rank == "1", "codex").alias("source"),
        (F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("file_mtime"),
        F.floor("o_totalprice").alias("file_size"),
        F.when(rank == "2", "failed").when(rank == "3", "stale").otherwise("imported").alias("import_status"),
        F.when(key % 7 != 0, key % 50).alias("event_count"),
        F.when(key % 11 != 0, key % 90).alias("line_count"),
        F.date_format(day, "yyyy-MM-dd").alias("started_at"),
        F.when(key % 4 != 0, F.concat(F.col("o_orderpriority"), F.lit(" "), (key % 13).cast("string"))).alias("description"),
    )


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later scan would find: some files gone, some grown, some new."""
    known = sessions(spark, sf_dir)
    key = F.col("id")
    kept = known.where(key % 10 != 0).select(
        "file_path", "file_tier", "project_id", "session_uuid", "agent_id", "workflow_run_id",
        (F.col("file_mtime") + F.when(key % 9 == 0, 60).otherwise(0)).alias("file_mtime"),
        (F.col("file_size") + F.when(key % 8 == 0, 5).otherwise(0)).alias("file_size"),
    )
    fresh = known.where(key % 10 == 0).select(
        F.concat("file_path", F.lit(".new")).alias("file_path"), "file_tier", "project_id", "session_uuid", "agent_id", "workflow_run_id", "file_mtime", "file_size"
    )
    return kept.unionByName(fresh)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("session_id"),
        v.alias("seq"),
        F.lit(0).alias("chunk_index"),
        F.when(v % 3 == 0, "hash/th/r1/64").otherwise("hash/en/r1/64").alias("model"),
        F.when(v % 4 == 0, "tools").otherwise("chat").alias("vector_class"),
        F.size("embedding").alias("dim"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("chunk "), (v % 40).cast("string")).alias("text"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the lines of one file a user; every fifth stamp is missing."""
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_type").alias("line_type"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("ts"), "value"
    )


#: The same tables as DuckDB common table expressions.
SQL = {
    "ev": "ev AS (SELECT conv_id AS session_id, turn AS seq, role, text FROM conversations)",
    "pr": """pr AS (SELECT c_custkey AS id, '-home-' || c_name AS dir_name,
        CASE WHEN c_custkey % 5 <> 0 THEN '/home/' || lower(c_mktsegment) || '/' || c_name END AS cwd,
        '2024-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS first_seen_at FROM customer)""",
    "se": """se AS (SELECT o_orderkey AS id, o_custkey AS project_id, md5(CAST(o_orderkey - o_orderkey % 3 AS VARCHAR)) AS session_uuid,
        '/corpus/' || o_custkey || '/' || o_orderkey || '.jsonl' AS file_path,
        CASE o_orderstatus WHEN 'F' THEN 'session' WHEN 'O' THEN 'subagent' ELSE 'workflow_agent' END AS file_tier,
        CASE WHEN o_orderstatus <> 'F' THEN 'agent-a' || o_orderkey END AS agent_id,
        CASE WHEN o_orderstatus = 'P' THEN 'wf_' || (o_orderkey % 100) END AS workflow_run_id,
        CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'codex' END AS source,
        CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 AS BIGINT) AS file_mtime,
        CAST(floor(o_totalprice) AS BIGINT) AS file_size,
        CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'failed' WHEN '3' THEN 'stale' ELSE 'imported' END AS import_status,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS event_count,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 90 END AS line_count,
        strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS started_at,
        CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority || ' ' || (o_orderkey % 13) END AS description FROM orders)""",
    "dk": """dk AS (SELECT file_path, file_tier, project_id, session_uuid, agent_id, workflow_run_id,
        file_mtime + CASE WHEN id % 9 = 0 THEN 60 ELSE 0 END AS file_mtime, file_size + CASE WHEN id % 8 = 0 THEN 5 ELSE 0 END AS file_size
        FROM se WHERE id % 10 <> 0
        UNION ALL SELECT file_path || '.new', file_tier, project_id, session_uuid, agent_id, workflow_run_id, file_mtime, file_size FROM se WHERE id % 10 = 0)""",
    "ve": """ve AS (SELECT CAST(label AS BIGINT) AS session_id, vec_id AS seq, 0 AS chunk_index,
        CASE WHEN vec_id % 3 = 0 THEN 'hash/th/r1/64' ELSE 'hash/en/r1/64' END AS model,
        CASE WHEN vec_id % 4 = 0 THEN 'tools' ELSE 'chat' END AS vector_class, CAST(len(embedding) AS INTEGER) AS dim,
        list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector, 'chunk ' || (vec_id % 40) AS text FROM embeddings)""",
    "li": "li AS (SELECT user_id, event_id, event_type AS line_type, CASE WHEN event_id % 5 <> 0 THEN event_id END AS ts, value FROM events)",
}


def with_tables(names: str, select: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + "\n" + select
