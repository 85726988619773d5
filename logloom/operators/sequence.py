"""Ordered operators: folds, beats, interleaving, retention, chunk windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.language import unspaced
from logloom.operators.segment import Segmenter, lattice, segmented_chunks


def fold_state_runs(rows: DataFrame, key: str, order: str, line_type: str, ts: str, states: tuple[str, ...]) -> DataFrame:
    """Each maximal run of state rows becomes one row; others pass. A row: key, first order, is_state, count,
    types in order of first sight, last stamp that is not null."""
    state = F.col(line_type).isin(*states)
    w = Window.partitionBy(key).orderBy(order)
    # rows up to and with each that is no state: a run of states shares the number of the row before it
    island = F.sum(F.when(state, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = F.col(ts).isNotNull()
    run = [key, "island", "is_state"]
    kinds = rows.select("*", state.alias("is_state"), island.alias("island")).groupBy(*run, line_type).agg(
        F.min(order).alias("first_id"), F.count("*").alias("count"), F.max(F.when(seen, F.struct(F.col(order).alias("o"), F.col(ts).alias("t")))).alias("last")
    )
    # a run has a row a type here, however long it is
    types = F.array_sort(F.collect_list(F.struct(F.col("first_id").alias("o"), F.col(line_type).alias("t"))))
    folded = kinds.groupBy(*run).agg(
        F.min("first_id").alias("first_id"), F.sum("count").alias("count"), F.transform(types, lambda x: x["t"]).alias("types"), F.max("last").alias("last")
    )
    return folded.select(key, "is_state", "first_id", "count", "types", F.col("last.t").alias("last_ts"))


def beats(lines: DataFrame, key: str, order: str, is_beat: Column) -> DataFrame:
    """Numbers each line by the last beat before it (from 1); lines before the first are left out."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("beat", F.count_if(is_beat).over(w)).where("beat > 0")


def spine_edges(numbered: DataFrame, key: str) -> DataFrame:
    """Edges between a key's consecutive beats."""
    w = Window.partitionBy(key).orderBy("beat")
    return numbered.select(key, "beat").distinct().select(key, F.lag("beat").over(w).alias("a"), F.col("beat").alias("b")).where("a IS NOT NULL")


def recurring_targets(touches: DataFrame, key: str, target: str) -> DataFrame:
    """touches: (key, beat, target). Links between consecutive beats of targets that several beats touch."""
    w = Window.partitionBy(key, target).orderBy("beat")
    each = touches.select(key, target, "beat").distinct()
    return each.select(key, target, F.col("beat").alias("a"), F.lead("beat").over(w).alias("b")).where("b IS NOT NULL")


def keep_best(rows: DataFrame, text: str, score: str, *ties: str, chars: int = 60) -> DataFrame:
    """Of rows whose texts begin alike the one with the highest score; ties by the columns named. An aggregate, so
    a beginning that many texts share is reduced before the shuffle."""
    down = F.struct(F.col(score), *((-F.col(c)).alias(f"t{k}") for k, c in enumerate(ties)))
    best = rows.groupBy(F.substring(text, 1, chars).alias("beginning")).agg(F.max_by(F.struct(*rows.columns), down).alias("r"))
    return best.select("r.*")


def interleave(rows: DataFrame, source: str, order: list[Column], limit: int) -> DataFrame:
    """The i-th row of each source in turn, sources by name."""
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(source).orderBy(*order)).cast("long"))
    return ranked.orderBy("position", source).limit(limit)


def retain_newest(rows: DataFrame, order: str, n: int = 150) -> DataFrame:
    """The newest rows, as a sort with a limit: no single-partition window."""
    return rows.orderBy(F.col(order).desc()).limit(n)


def with_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with __words, the text's words. The condition always holds; it keeps the optimizer from copying the
    split into every use of its result."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return rows.withColumn("__words", F.when(F.spark_partition_id() >= 0, words))


def chunk_texts(parts: Column, words: int = 100, stride: int = 50, most: int = 32) -> Column:
    """array<string> of an array of words: windows that overlap, ``most`` at most (0: all); a short text is its one chunk."""
    n = F.size(parts)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda i: (i == 0) | (i - stride + words < n))
    windows = F.transform(F.slice(starts, 1, most) if most > 0 else starts, lambda i: F.array_join(F.slice(parts, i + 1, words), " "))
    return F.filter(windows, lambda x: x != "")


def chunks(events: DataFrame, words: int = 100, stride: int = 50, most: int = 32, *keep: Column, segmenter: Segmenter | None = lattice) -> DataFrame:
    """A row a chunk: (session_id, seq, chunk_index, text) and what is to be kept. Words are what stands between blanks;
    texts with letters of scripts without blanks go through the segmenter (None: they are taken as the others)."""
    rows = events.select("session_id", "seq", "text", *keep)
    if segmenter is None:
        return _blank_chunks(rows, words, stride, most)
    east = F.coalesce(unspaced(F.col("text")), F.lit(False))
    others = _blank_chunks(rows.where(~east), words, stride, most)
    return others.unionByName(segmented_chunks(rows.where(east), segmenter, words, stride, most).select(*others.columns))


def _blank_chunks(rows: DataFrame, words: int, stride: int, most: int) -> DataFrame:
    own = with_words(rows)
    rest = [c for c in own.columns if c not in ("session_id", "seq", "text", "__words")]
    each = own.select("session_id", "seq", *rest, F.posexplode_outer(chunk_texts(F.col("__words"), words, stride, most)).alias("chunk_index", "text"))
    return each.where("text IS NOT NULL").withColumn("chunk_index", F.col("chunk_index").cast("long"))


def arrivals(snapshots: DataFrame, key: str, at: str, first_at: int) -> DataFrame:
    """snapshots: (key, at). When each key came to be seen anew: not in the snapshot before; the first one tells nothing."""
    turns = snapshots.select(at).distinct().withColumn("turn", F.row_number().over(Window.orderBy(at)))  # one row a snapshot
    seen = snapshots.join(F.broadcast(turns), at).select(key, at, "turn")
    before = F.lag("turn").over(Window.partitionBy(key).orderBy("turn"))
    return seen.withColumn("before", before).where((F.col("before").isNull() | (F.col("before") < F.col("turn") - 1)) & (F.col(at) > first_at)).select(key, F.col(at).alias("arrived_at"))
