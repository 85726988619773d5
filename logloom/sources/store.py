"""The index as stored tables: Parquet folders below one root, written as whole versions.

A table is the newest complete version below its folder; replacing one writes the next version and then
drops those before the last two, so a reader is never left without files and an executor lost on the way
leaves the old version as it was. What grows with the corpus is partitioned and never replaced as a whole:
events and type counts by a bucket of their session, of which an import rewrites those that it touches, and
vectors by class and model. Run logs get a row when a run begins and another when it ends. Nothing that grows
with the corpus is brought to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from logloom import schemas
from logloom.operators import search, textindex
from logloom.operators import vectors as vector_ops
from logloom.operators.sessions import with_projects
from logloom.sources import transcripts

TABLES = {
    "projects": schemas.PROJECTS,
    "sessions": schemas.SESSIONS,
    "session_type_counts": schemas.SESSION_TYPE_COUNTS,
    "events": schemas.EVENTS,
    "postings": schemas.POSTINGS,
    "indexed": schemas.INDEXED,
    "import_runs": schemas.IMPORT_RUNS,
    "event_vectors": schemas.EVENT_VECTORS,
    "vector_stats": schemas.VECTOR_STATS,
    "vector_runs": schemas.VECTOR_RUNS,
    "topics": schemas.TOPICS,
    "topic_hits": schemas.TOPIC_HITS,
    "search_log": schemas.SEARCH_LOG,
}
PARTITIONS = {"event_vectors": ["vector_class", "model"], "events": ["bucket"], "session_type_counts": ["bucket"], "postings": ["kind", "part"], "indexed": ["bucket"]}
#: Parquet's own settings: postings are sorted by term, so small row groups leave little to read beside a term.
OPTIONS = {"postings": {"parquet.block.size": 8 << 20}}
#: What vector statistics are kept by.
KEYS = ("vector_class", "model")
#: The text index is compacted when it has grown by so many segments.
COMPACT_EVERY = 32
#: Buckets of sessions.
BUCKETS = 256


def bucket(session_id: Column) -> Column:
    return F.pmod(session_id, F.lit(BUCKETS)).cast("int").alias("bucket")


class Store:
    """Tables below a root that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        """The complete versions, oldest first."""
        folder = self._path(f"{self.root}/{table}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS")))

    def init(self) -> None:
        """Creates the tables that are not there yet, empty; those that are stay as they are."""
        for table, schema in TABLES.items():
            if not self._versions(table):
                self._writer(table, self.spark.createDataFrame([], schema), "overwrite").parquet(f"{self.root}/{table}/v0")

    def read(self, table: str) -> DataFrame:
        """The newest version. Columns that older files lack are null."""
        versions = self._versions(table)
        schema = TABLES[table]
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self._read(table, f"{self.root}/{table}/v{versions[-1]}").select(*schema.names)

    def _read(self, table: str, path: str) -> DataFrame:
        """With the column of its partitions."""
        schema = TABLES[table]
        if PARTITIONS.get(table) == ["bucket"]:
            schema = StructType([*schema.fields, StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).parquet(path)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Writes the table's next version; rows may be derived from the current one."""
        versions = self._versions(table)
        following = versions[-1] + 1 if versions else 0
        self._writer(table, rows, "overwrite").parquet(f"{self.root}/{table}/v{following}")
        for old in versions[:-1]:
            self._fs.delete(self._path(f"{self.root}/{table}/v{old}"), True)

    def append(self, table: str, rows: DataFrame) -> None:
        versions = self._versions(table)
        self._writer(table, rows, "append").parquet(f"{self.root}/{table}/v{versions[-1] if versions else 0}")

    def _writer(self, table: str, rows: DataFrame, mode: str):
        typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields))
        if PARTITIONS.get(table) == ["bucket"]:
            typed = typed.withColumn("bucket", bucket(F.col("session_id")))
        writer = typed.write.mode(mode).options(**OPTIONS.get(table, {}))
        return writer.partitionBy(*PARTITIONS[table]) if table in PARTITIONS else writer

    def _overwrite_partitions(self, table: str, rows: DataFrame) -> None:
        """Replaces the partitions that rows has, and no others; rows may be derived from them."""
        staging = self._staging()
        self._writer(table, rows, "overwrite").parquet(staging)
        fresh = self._read(table, staging).select(*TABLES[table].names)
        path = f"{self.root}/{table}/v{self._versions(table)[-1]}"
        self._writer(table, fresh, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        self._discard(staging)

    def replace_sessions(self, table: str, rows: DataFrame, ids: DataFrame) -> None:
        """rows instead of what the table has of the sessions ids; only their buckets are read and written."""
        touched = [r["bucket"] for r in ids.select(bucket(F.col("session_id"))).distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        path = f"{self.root}/{table}/v{self._versions(table)[-1]}"
        kept = self._read(table, path).where(F.col("bucket").isin(touched)).join(ids.select("session_id").distinct(), "session_id", "left_anti")
        names = TABLES[table].names
        # a bucket whose last rows go is not in what is written: it must be emptied
        whole = kept.select(*names).unionByName(rows.select(*names))
        left = {r["bucket"] for r in whole.select(bucket(F.col("session_id"))).distinct().collect()}
        self._overwrite_partitions(table, whole)
        for b in set(touched) - left:
            self._discard(f"{path}/bucket={b}")

    def session_events(self, session_id: int) -> DataFrame:
        """One session's events, of its bucket's files alone."""
        path = f"{self.root}/events/v{self._versions('events')[-1]}"
        return self._read("events", path).where((F.col("bucket") == session_id % BUCKETS) & (F.col("session_id") == session_id)).select(*TABLES["events"].names)

    def views(self) -> None:
        """Every table as a view, for SQL of one's own."""
        for table in TABLES:
            self.read(table).createOrReplaceTempView(table)

    def runs(self, table: str) -> DataFrame:
        """A log's rows, the last state of each run."""
        rows = self.read(table)
        rest = [c for c in rows.columns if c != "id"]
        return rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.coalesce("finished_at", F.lit(""))).alias("r")).select("id", "r.*")

    def _log(self, table: str, **row) -> None:
        schema = TABLES[table]
        self.append(table, self.spark.createDataFrame([tuple(row.get(n) for n in schema.names)], schema))

    def log_search(self, id: int, ts: str, query: str, engine: str, hits: int, ms: int, top: float | None, spread: float | None) -> None:
        """Appends a row about a search, however many write at once. The log is compacted now and then."""
        self._log("search_log", id=id, ts=ts, query=query, engine=engine, hits=hits, ms=ms, top_score=top, score_spread=spread)
        if id % COMPACT_EVERY == 0:
            self.replace("search_log", self.read("search_log").coalesce(1))

    def _staging(self) -> str:
        return f"{self.root}/_staging/{uuid.uuid4().hex}"

    def _discard(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # --- imports

    def import_transcripts(self, root: str, now: str, run_id: int, finished: Callable[[], str] | None = None, source: str | None = None, **narrow) -> dict[str, int]:
        """One logged import below root; narrow: only, since, force. A run that breaks off stays without an end."""
        files = transcripts.discover_files(self.spark, root)
        self._log("import_runs", id=run_id, started_at=now, files_scanned=files.count())
        staging = self._staging()
        result = transcripts.incremental_import(self.spark, root, self.read("sessions"), now, staging, source=source, **narrow)
        self._take(result)
        self._discard(staging)
        self._log("import_runs", id=run_id, started_at=now, finished_at=finished() if finished else now, **result.counts)
        return result.counts

    def import_rollouts(self, root: str, now: str) -> dict[str, int]:
        """The same for rollout files; it is not logged."""
        staging = self._staging()
        result = transcripts.rollout_import(self.spark, root, self.read("sessions"), now, staging)
        self._take(result)
        self._discard(staging)
        return result.counts

    def sync(self, roots: dict[str, str], now: str, run_id: int, **narrow) -> dict[str, dict[str, int]]:
        """Imports below every named root, one run each."""
        return {name: self.import_transcripts(root, now, run_id + k, **narrow) for k, (name, root) in enumerate(sorted(roots.items()))}

    def _take(self, result: transcripts.ImportResult) -> None:
        """The imported rows replace those of their sessions. Sessions come last: they are what says a file is done."""
        ids = result.sessions.select(F.col("id").alias("session_id"), "import_status").where("import_status = 'imported'").select("session_id")
        # agents may wait for a parent that is imported only now
        stored = transcripts.replace_by_key(self.read("sessions"), result.sessions, "id")
        sessions = transcripts.link_parents(stored)
        self.replace("projects", transcripts.upsert_projects(self.read("projects"), result.projects))
        for table, rows in (("session_type_counts", result.type_counts), ("events", result.events)):
            self.replace_sessions(table, rows, ids)
        self._index(result.events.join(ids, "session_id", "left_semi"), ids)
        self.replace("sessions", sessions.select(*schemas.SESSIONS.names))

    # --- the text index

    def _index(self, events: DataFrame, ids: DataFrame) -> None:
        """A segment with the postings of the sessions ids; what older segments have of them counts no more."""
        segment = (self.read("indexed").agg(F.max("segment")).first()[0] or 0) + 1
        self.append("postings", textindex.postings(events, segment))
        self.replace_sessions("indexed", textindex.indexed(events, segment), ids)
        if segment % COMPACT_EVERY == 0:
            self.compact_index()

    def compact_index(self) -> None:
        """Writes the postings that count as the table's next version."""
        live = self.read("indexed").select("session_id", "segment")
        kept = self.read("postings").join(live, ["session_id", "segment"], "left_semi").select(*schemas.POSTINGS.names)
        salt = F.pmod(F.xxhash64("session_id", "seq"), F.lit(textindex.SALTS))
        self.replace("postings", kept.repartition("kind", "part", salt).sortWithinPartitions("kind", "part", "term", "session_id", "seq"))

    def index_events(self) -> None:
        """Indexes all stored events anew, as for a store that was made before there was an index."""
        events = self.read("events")
        self.replace("postings", textindex.postings(events, 1))
        self.replace("indexed", textindex.indexed(events, 1))

    def has_index(self) -> bool:
        return not self.read("indexed").isEmpty()

    def search(self, text: str, limit: int = 200, engine: str | None = None, **filters: str | None) -> DataFrame:
        """search.search_filtered from the index: scores from postings, then the best events from their buckets."""
        kept = with_projects(self.read("sessions"), self.read("projects")).where(search.session_filter(**filters))
        named = kept.select(F.col("id").alias("session_id"), "session_uuid", "file_tier", "cwd", "dir_name", "started_at")
        hits = textindex.scored(self.read("postings"), self.read("indexed"), search.compile_query(text, engine))
        best = hits.join(named, "session_id").orderBy("score", "session_id", "seq").limit(limit).withColumn("bucket", bucket(F.col("session_id")))
        path = f"{self.root}/events/v{self._versions('events')[-1]}"
        rows = self._read("events", path)
        # limit rows at most; their buckets alone are read
        both = rows.join(F.broadcast(best) if limit <= textindex.BROADCAST_ROWS else best, ["bucket", "session_id", "seq"]).drop("bucket")
        return both.select("session_id", *(c for c in schemas.EVENTS.names if c != "session_id"), "score", *(c for c in named.columns if c != "session_id")).orderBy("score", "session_id", "seq")

    # --- vectors

    def build_embeddings(self, models: list[str], now: str, run_id: int, provider=vector_ops.hashing_provider, name: str = "hash", dim: int = 64, words: int = 100, stride: int = 50, **work) -> dict[str, int]:
        """Embeds the work list and appends it; counts are of what is stored."""
        log = {"id": run_id, "model": models[0], "provider": name, "chunk_words": words, "chunk_stride": stride, "started_at": now}
        self._log("vector_runs", **log)
        before, staging = self.read("event_vectors"), self._staging()
        fresh = vector_ops.build_embeddings(self.read("events"), before, models, provider, dim, words, stride, **work)
        fresh.write.parquet(staging)  # embedded once
        done = self.spark.read.schema(fresh.schema).parquet(staging)
        good = done.where("vector IS NOT NULL")
        n = good.agg(F.count("*").alias("vectors"), F.countDistinct("session_id", "seq").alias("events")).first()
        counts = {"events": n["events"], "vectors": n["vectors"], "skipped": done.where("vector IS NULL").count()}
        self.append("event_vectors", good)
        self.append("vector_stats", vector_ops.vector_sums(good, *KEYS))
        self._discard(staging)
        self._log("vector_runs", **log, finished_at=now, stopped=False, **counts)
        return counts

    def load_vectors(self, path: str, model: str, vector_class: str, now: str, run_id: int) -> tuple[int, int]:
        """(stored, refused) vectors of JSON lines; a vector already there under the same key is replaced."""
        log = {"id": run_id, "model": model, "provider": "load", "started_at": now}
        self._log("vector_runs", **log)
        good, refused = vector_ops.load_vectors(self.spark, path, model, vector_class)
        keys = ["session_id", "seq", "chunk_index"]
        stored = self.read("event_vectors").where((F.col("model") == model) & (F.col("vector_class") == vector_class))
        kept = stored.join(good.select(*keys), keys, "left_anti").select(*stored.columns)
        self._overwrite_partitions("event_vectors", kept.unionByName(good.select(*stored.columns)))
        fresh = self.read("event_vectors").where((F.col("model") == model) & (F.col("vector_class") == vector_class))
        others = self.read("vector_stats").where(~((F.col("model") == model) & (F.col("vector_class") == vector_class)))
        self.replace("vector_stats", others.unionByName(vector_ops.vector_sums(fresh, *KEYS)))
        n, bad = good.count(), refused.count()
        self._log("vector_runs", **log, finished_at=now, vectors=n, skipped=bad, stopped=False)
        return n, bad

    def drop_legacy_vectors(self, models: list[str], current: list[str]) -> None:
        self.replace("event_vectors", vector_ops.drop_legacy(self.read("event_vectors"), self.read("events"), models, current))
        self.replace("vector_stats", self.read("vector_stats").where(~F.col("model").isin(*models)))

    def vector_mean(self, model: str) -> list[float] | None:
        """The mean of a model's vectors from what was kept of them, a few rows; None without any."""
        return vector_ops.mean_of(self.read("vector_stats").where(F.col("model") == model)).first()["mean"] or None

    def refresh_vector_stats(self) -> None:
        """Statistics from the vectors themselves, as for a store that has none yet."""
        self.replace("vector_stats", vector_ops.vector_sums(self.read("event_vectors"), *KEYS))


def exists(spark: SparkSession, root: str) -> bool:
    """Whether an index is there at all."""
    try:
        return bool(Store(spark, root)._versions("sessions"))
    except Py4JJavaError:
        return False
