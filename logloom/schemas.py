"""Explicit schemas of the stored tables. Session start and end stay strings: ranges over them are lexical."""

from pyspark.sql import types as T


_KINDS = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    "ARRAY<INT>": T.ArrayType(T.IntegerType()), "ARRAY<STRING>": T.ArrayType(T.StringType()), "ARRAY<FLOAT>": T.ArrayType(T.FloatType()), "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType()), "ARRAY<BIGINT>": T.ArrayType(T.LongType()),
}


def _schema(text: str) -> T.StructType:
    """From "name KIND, ..."; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(", "))])


PROJECTS = _schema("id BIGINT, dir_name STRING, cwd STRING, first_seen_at STRING, last_seen_at STRING")
SESSIONS = _schema(
    "id BIGINT, project_id BIGINT, session_uuid STRING, file_path STRING, file_tier STRING, workflow_run_id STRING, agent_id STRING, "
    "parent_session_id BIGINT, source STRING, file_mtime BIGINT, file_size BIGINT, imported_at STRING, import_status STRING, "
    "import_error STRING, line_count BIGINT, event_count BIGINT, started_at STRING, ended_at STRING, description STRING"
)
SESSION_TYPE_COUNTS = _schema("session_id BIGINT, line_type STRING, count BIGINT")
EVENTS = _schema("session_id BIGINT, seq BIGINT, role STRING, ts STRING, text STRING")
POSTINGS = _schema("kind STRING, part INT, segment BIGINT, term STRING, session_id BIGINT, seq BIGINT, d INT, places ARRAY<INT>")
INDEXED = _schema("session_id BIGINT, segment BIGINT, n_rows BIGINT, token_length BIGINT, gram_length BIGINT")
EVENT_VECTORS = _schema("session_id BIGINT, seq BIGINT, chunk_index INT, model STRING, vector_class STRING, dim INT, vector ARRAY<FLOAT>, text STRING")
VECTOR_STATS = _schema("vector_class STRING, model STRING, sums ARRAY<DOUBLE>, counts ARRAY<BIGINT>")
IMPORT_RUNS = _schema(
    "id BIGINT, started_at STRING, finished_at STRING, files_scanned BIGINT, files_new BIGINT, files_changed BIGINT, files_skipped BIGINT, files_failed BIGINT"
)
VECTOR_RUNS = _schema(
    "id BIGINT, model STRING, provider STRING, endpoint STRING, chunk_words INT, chunk_stride INT, started_at STRING, finished_at STRING, "
    "events BIGINT, vectors BIGINT, skipped BIGINT, stopped BOOLEAN"
)
TOPICS = _schema(
    "name STRING, query STRING, engine STRING, description STRING, created_at STRING, last_run_at STRING, runs BIGINT, last_hits BIGINT, "
    "promoted BOOLEAN, sources ARRAY<STRING>"
)
TOPIC_HITS = _schema("topic STRING, session_id BIGINT, uuid STRING, role STRING, ts STRING, score DOUBLE, snippet STRING, captured_at STRING, source STRING")
SEARCH_LOG = _schema("id BIGINT, ts STRING, query STRING, engine STRING, model STRING, hits BIGINT, ms BIGINT, top_score DOUBLE, score_spread DOUBLE")
TAIL_ROWS = _schema("path STRING, offset BIGINT, line STRING, truncated BOOLEAN")
EVAL_QUERIES = _schema("query STRING, mode STRING, expect STRING, ids ARRAY<STRING>")
VECTOR_LOAD = _schema("session_id BIGINT, seq BIGINT, chunk_index INT, dim INT, vector ARRAY<DOUBLE>, text STRING")
