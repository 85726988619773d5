"""Remembered queries over several sources, with memoised hits."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.sequence import interleave

HIT_COLUMNS = ("session_id", "uuid", "role", "ts", "score", "snippet")


def trace(name: str, sources: dict[str, Callable[[], DataFrame]], captured_at: str, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """(hits of all sources that answer, errors of the others). Each source gives HIT_COLUMNS; write runs its plan,
    stores the rows and gives them back, so a source that fails while it runs takes no other along."""
    frames, errors = [], {}
    for source in sorted(sources):
        try:
            frames.append(write(sources[source]().select(*HIT_COLUMNS).withColumn("source", F.lit(source))))
        except Exception as error:  # of someone else's making: told, not raised
            errors[source] = f"{type(error).__name__}: {error}"
    if not frames:
        return None, errors
    hits = reduce(DataFrame.unionByName, frames)
    return hits.withColumn("topic", F.lit(name)).withColumn("captured_at", F.lit(captured_at)), errors


def replace_hits(stored: DataFrame, topic: str, hits: DataFrame) -> DataFrame:
    """stored with the topic's hits replaced; one row a (topic, session, snippet)."""
    others = stored.where(F.col("topic") != topic)
    return others.unionByName(hits.dropDuplicates(["topic", "session_id", "snippet"]).select(*stored.columns))


def upsert_topic(topics: DataFrame, new: DataFrame) -> DataFrame:
    """new topics by name; a missing description keeps the old one, creation and counts stay."""
    old = topics.select("name", *(F.col(c).alias(f"old_{c}") for c in topics.columns if c != "name"))
    kept = {"description": F.coalesce("description", "old_description"), "created_at": F.coalesce("old_created_at", "created_at"), "runs": F.coalesce("old_runs", "runs"), "promoted": F.coalesce("old_promoted", "promoted")}
    merged = new.join(old, "name", "left").select(*(kept.get(c, F.col(c)).alias(c) for c in topics.columns))
    return topics.join(new.select("name"), "name", "left_anti").select(*topics.columns).unionByName(merged)


def finish_run(topics: DataFrame, name: str, hits: int, at: str) -> DataFrame:
    own = F.col("name") == name
    return topics.withColumn("runs", F.when(own, F.col("runs") + 1).otherwise(F.col("runs"))).withColumn("last_hits", F.when(own, F.lit(hits)).otherwise(F.col("last_hits"))).withColumn(
        "last_run_at", F.when(own, F.lit(at)).otherwise(F.col("last_run_at"))
    )


def set_promoted(topics: DataFrame, name: str, promoted: bool) -> DataFrame:
    return topics.withColumn("promoted", F.when(F.col("name") == name, F.lit(promoted)).otherwise(F.col("promoted")))


def forget(topics: DataFrame, hits: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return topics.where(F.col("name") != name), hits.where(F.col("topic") != name)


def dig(hits: DataFrame, topic: str, limit: int = 20) -> DataFrame:
    """A topic's hits, its sources in turn; the pool is the first eight times limit by (source, score)."""
    order = [F.col("score").asc_nulls_last(), F.col("captured_at").desc(), F.col("session_id"), F.col("snippet")]
    pool = hits.where(F.col("topic") == topic).orderBy("source", *order).limit(8 * limit)
    return interleave(pool, "source", order, limit)


def source_counts(hits: DataFrame, topic: str) -> DataFrame:
    return hits.where(F.col("topic") == topic).groupBy("source").agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "source")


# Where an outside tool's answer has its rows, and a row its text.
CONTAINERS = ("results", "items", "matches", "data", "memories", "entries")
TEXTS = ("content", "text", "snippet", "summary", "body", "title", "name")


def hits_of_text(text: str, limit: int = 20) -> list[str]:
    """Snippets in an outside tool's answer: the rows of a JSON list, or of the first list in it, each with its type;
    rows of an unknown shape stay as they are. Without rows: the lines of more than 30 characters."""
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    rows_of = lambda x: x if isinstance(x, list) and x and all(isinstance(r, dict) for r in x) else []
    rows = rows_of(data) or next((rows_of(data[k]) for k in CONTAINERS if rows_of(data.get(k))), []) if isinstance(data, (list, dict)) else []

    def shown(row: dict) -> str:
        value = next((row[k] for k in TEXTS if isinstance(row.get(k), str) and row[k]), None)
        if value is None:
            return json.dumps(row, ensure_ascii=False)
        label = f"[{row['type']}] " if isinstance(row.get("type"), str) else ""
        return label + value.replace("\n", " ")

    found = [shown(r) for r in rows] or [line for line in text.split("\n") if len(line) > 30]
    return [x[:300] for x in found[:limit]]


def hits_frame(spark: SparkSession, text: str, upstream: str, limit: int = 20) -> DataFrame:
    """HIT_COLUMNS of an outside tool's answer."""
    rows = [(0, upstream, "upstream", None, 0.0, x) for x in hits_of_text(text, limit)]
    return spark.createDataFrame(rows, "session_id long, uuid string, role string, ts string, score double, snippet string")
