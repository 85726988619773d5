"""Lines of text files with their places: numbered by order and by byte, whatever way the files are split.

A place is a prefix sum: within a split by a window over the split, before it by the totals of the file's earlier
splits, which are one row each. So a huge file is numbered by as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def raw_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file_path, size, block, k, raw: every line, in the order of (block, k) within its file."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        # as a listing spells it: the metadata has an encoded URL
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file_path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("raw"),
    )


def running(rows: DataFrame, **amounts: Column) -> DataFrame:
    """rows (file_path, block, k, ...) with, for each name, the sum of its amount over the file's rows before, and
    all_name, that over all rows of the file."""
    split = ["file_path", "block"]
    before = Window.partitionBy(*split).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *(F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"__{n}") for n, a in amounts.items()))
    totals = rows.groupBy(*split).agg(*(F.sum(a).alias(n) for n, a in amounts.items()))
    # a row a split
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("file_path")
    ahead = totals.select(*split, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in amounts), *(F.sum(n).over(file).alias(f"all_{n}") for n in amounts))
    places = [(F.col(f"__{n}") + F.col(f"__before_{n}")).alias(n) for n in amounts]
    return own.join(ahead, split).select(*rows.columns, *places, *(f"all_{n}" for n in amounts))


def as_object(raw: str = "raw") -> Column:
    """The line as VARIANT if it is a JSON object, else null."""
    return F.expr(f"CASE WHEN startswith(ltrim({raw}), '{{') THEN try_parse_json({raw}) END")


def parsed_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file_path, block, k, pos (from 0, blank lines too), line (from 0, blank ones not counted), last (whether no
    newline ends it), raw, v (null: no JSON object)."""
    full = (F.trim("raw") != "").cast("int")
    placed = running(raw_lines(spark, paths), pos=F.lit(1), line=full, at=F.octet_length("raw") + 1)
    last = (F.col("all_at") > F.col("size")) & (F.col("pos") == F.col("all_pos") - 1)
    return placed.select("file_path", "block", "k", "pos", "line", last.alias("last"), "raw", as_object().alias("v"))


def located_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """session_id (the path), seq (the byte at which the line begins), size, v; a last line without a newline waits."""
    placed = running(raw_lines(spark, paths), at=F.octet_length("raw") + 1)
    lines = placed.where(F.col("at") + F.octet_length("raw") + 1 <= F.col("size"))
    return lines.select(F.col("file_path").alias("session_id"), F.col("at").alias("seq"), "size", as_object().alias("v"))
