"""Retrieval evaluation: recall@k and mean reciprocal rank, all queries in one plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.query import compile_query
from logloom.operators import textindex
from logloom.operators.vectors import semantic_search_many


def load_queries(spark, path: str) -> DataFrame:
    """JSON lines with // comments; a query with ids is labelled unless it says otherwise."""
    schema = "query string, mode string, expect string, ids array<string>"
    lines = spark.read.text(path).where(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    rows = lines.select(F.from_json("value", schema).alias("q")).select("q.*").where("query IS NOT NULL")
    return rows.withColumn("mode", F.coalesce("mode", F.when(F.col("ids").isNull(), "substring").otherwise("labeled")))


def distinct_ranks(hits: DataFrame, query: str = "query_id", item: str = "item_id", rank: str = "rank") -> DataFrame:
    """Each item once, by its first rank, numbered anew."""
    first = hits.groupBy(query, item).agg(F.min(rank).alias("first"))
    return first.select(query, item, F.row_number().over(Window.partitionBy(query).orderBy("first", item)).cast("long").alias("rank"))


def evaluate(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """A row a query: n_truth, recall@k (of at most k), reciprocal rank over the whole list. hits: (query_id,
    item_id, rank); truth: (query_id, item_id)."""
    wanted = truth.select("query_id", "item_id").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    found = distinct_ranks(hits).join(wanted, ["query_id", "item_id"], "left_semi")
    counted = found.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks), F.min("rank").alias("best"))
    zero = F.lit(0)
    return sizes.join(counted, "query_id", "left").select(
        "query_id",
        "n_truth",
        *((F.coalesce(f"hits_{k}", zero) / F.least(F.lit(k), "n_truth")).alias(f"recall_{k}") for k in ks),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"),
    )


def means(evaluated: DataFrame, modes: DataFrame) -> DataFrame:
    """Averages by mode; modes are never mixed."""
    columns = [c for c in evaluated.columns if c.startswith("recall_")] + ["rr"]
    return evaluated.join(modes, "query_id").groupBy("mode").agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in columns))


def candidate_terms(events: DataFrame, terms: DataFrame, least: int = 3, count: int = 10) -> DataFrame:
    """The first terms (by position) that stand in the texts of ``least`` sessions or more. terms: a short list."""
    if terms.limit(10_001).count() > 10_000:
        raise ValueError("at most 10,000 candidate terms")
    hits = events.join(F.broadcast(terms), F.lower("text").contains(F.lower("term")))
    sessions = hits.groupBy("term", "position").agg(F.countDistinct("session_id").alias("sessions"))
    return sessions.where(F.col("sessions") >= least).orderBy("position").limit(count)


#: Hits fetched of each engine: a session has several, and only the first counts.
FETCH = 400


def ground_truth(queries: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, item_id): the sessions that a labelled query names (session, or session:line), and those in whose texts a
    substring query's words stand. queries: (query_id, query, mode, expect, ids), a short list."""
    named = queries.where("mode = 'labeled'").select("query_id", F.explode("ids").alias("id")).select("query_id", F.split("id", ":")[0].cast("long").alias("item_id"))
    asked = F.broadcast(queries.where("mode = 'substring'").select("query_id", F.concat(F.lit("%"), F.coalesce("expect", "query"), F.lit("%")).alias("like")))
    found = events.join(asked, F.expr("text ILIKE like")).select("query_id", F.col("session_id").alias("item_id"))
    return named.unionByName(found).distinct()


def harness(
    queries: DataFrame, events: DataFrame, vectors: DataFrame, embed: Callable[[str], tuple[str, list[float]]], ks: tuple[int, ...] = (10, 50), fetch: int = FETCH,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """A row a query: mode, n_truth, n_embedded, recall and reciprocal rank of text search (kw_) and of semantic search
    (sem_), the latter among the true sessions that have a vector at all, and no_coverage where none has. embed: a
    text's (model, vector). index: (postings, indexed), where one is kept; else the events are indexed on the way. One
    plan for all queries of text search, and one for those of each model."""
    asked = queries.collect()
    if len(asked) > 10_000:
        raise ValueError("at most 10,000 queries")
    postings, indexed = index or (textindex.postings(events, 1), textindex.indexed(events, 1))
    spark = events.sparkSession
    texts = textindex.search_many(postings, indexed, [(q["query_id"], compile_query(q["query"])) for q in asked], fetch)
    by_model: dict[str, list[tuple[int, list[float]]]] = {}
    for q in asked:
        model, vector = embed(q["query"])
        by_model.setdefault(model, []).append((q["query_id"], [float(x) for x in vector]))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "session_id", "seq")
    semantic = []
    for model, rows in by_model.items():  # a language each
        hits = semantic_search_many(vectors.where(F.col("model") == model), spark.createDataFrame(rows, "query_id int, vector array<double>"), fetch)
        semantic.append(hits.select("query_id", F.col("session_id").alias("item_id"), F.row_number().over(order).alias("rank")))
    ranked = {"kw": texts.select("query_id", F.col("session_id").alias("item_id"), "rank"), "sem": reduce(DataFrame.unionByName, semantic) if semantic else None}
    truth = ground_truth(queries, events)
    embedded = truth.join(vectors.select(F.col("session_id").alias("item_id")).distinct(), "item_id", "left_semi")
    out = queries.select("query_id", "query", "mode")
    for kind, wanted, size in (("kw", truth, "n_truth"), ("sem", embedded, "n_embedded")):
        scores = evaluate(ranked[kind] if ranked[kind] is not None else wanted.where("false").withColumn("rank", F.lit(1)), wanted, ks)
        out = out.join(scores.select("query_id", F.col("n_truth").alias(size), *(F.col(c).alias(f"{kind}_{c}") for c in scores.columns if c not in ("query_id", "n_truth"))), "query_id", "left")
    filled = out.fillna(0)
    return filled.withColumn("no_coverage", (F.col("n_truth") > 0) & (F.col("n_embedded") == 0))


def mode_means(rows: DataFrame) -> DataFrame:
    """A harness's averages by mode; modes are never mixed."""
    columns = [c for c in rows.columns if c.startswith(("kw_", "sem_"))]
    return rows.groupBy("mode").agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in columns))


def written_queries(terms: DataFrame, labelled: list[str]) -> list[str]:
    """The lines of a query file: a substring query a term (candidate_terms), and labelled lines kept from before."""
    own = [json.dumps({"query": r["term"], "mode": "substring", "expect": r["term"]}, ensure_ascii=False) for r in terms.orderBy("position").collect()]
    kept = [line for line in labelled if line.strip().startswith("{") and '"labeled"' in line]
    return own + (["// labelled by hand"] + kept if kept else [])
