"""Session graphs: beats, tools and targets as nodes, with weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.blocks import block_array, extract_text, field, first_line, graph_target, tool_calls
from logloom.operators.sequence import recurring_targets, spine_edges
from logloom.sources import ranges
from logloom.sources.lines import as_object, located_lines


#: Bytes of a file that a graph is made of, from its end.
READ_CAP = 8 << 20


def graph_lines(spark: SparkSession, paths: list[str] | str, cap: int = READ_CAP) -> DataFrame:
    """The lines that a session's graph is made of, a row a beat (a user's line with text: label) or tool call
    (call, tool, target), of each file's last ``cap`` bytes; of its first where no line begins in those. Nothing else
    is read, where the paths allow it. session_id is the file's path, seq the line's byte offset, truncated whether the
    file has lines before."""
    files = ranges.listed(spark, paths)
    if all(map(ranges.reachable, [paths] if isinstance(paths, str) else paths)):
        kept = ranges.tails(files, cap).select(F.col("file_path").alias("session_id"), F.col("offset").alias("seq"), "truncated", as_object().alias("v"))
    else:
        lines, file = located_lines(spark, paths), Window.partitionBy("session_id")
        start = F.greatest(F.col("size") - cap, F.lit(0))
        some = F.max(F.when(F.col("seq") >= start, 1).otherwise(0)).over(file) == 1
        placed = lines.select("*", some.alias("some"), start.alias("start")).where("seq >= start OR (NOT some AND seq < {0})".format(cap))
        kept = placed.select("session_id", "seq", (F.col("some") & (F.col("start") > 0)).alias("truncated"), "v")
    kind, v = field(F.col("v"), "$.type"), F.col("v")
    said = F.when(kind == "user", extract_text(v))
    label = F.when(said != "", F.substring(F.coalesce(F.nullif(first_line(said), F.lit("")), said), 1, 64))
    calls = F.when(label.isNull(), tool_calls(block_array(v)))
    rows = kept.where(kind.isNotNull()).select("session_id", "seq", "truncated", label.alias("label"), F.posexplode_outer(calls).alias("call", "c"))
    found = rows.where("label IS NOT NULL OR c IS NOT NULL")
    tool = F.when(F.col("c").isNotNull(), F.coalesce("c.name", F.lit("tool")))
    return found.select("session_id", "seq", "truncated", "label", "call", tool.alias("tool"), F.nullif(graph_target(F.col("c.input")), F.lit("")).alias("target"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines with beat, the number of the last label before or at each; calls before the first are left out."""
    w = Window.partitionBy("session_id").orderBy("seq", F.coalesce("call", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("beat", F.count("label").over(w)).where("beat > 0")


def session_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines: (session_id, seq, call, label, tool, target), of which a row is a beat if it has a label, else a call.
    Nodes (session_id, kind, name, label, weight, beats, node), numbered by first appearance, and edges (session_id,
    kind, a, b, weight) between names."""
    key, own = "session_id", numbered(lines)
    beat = F.format_string("beat %d", "beat")
    calls = own.where("label IS NULL AND tool IS NOT NULL").withColumn("pair", F.when(F.col("target").isNotNull(), F.concat_ws(" · ", "tool", "target")))
    place = F.struct("seq", F.coalesce("call", F.lit(0)).alias("call"), "rank")
    seen = own.where("label IS NOT NULL").select(key, "seq", "call", "beat", F.lit("beat").alias("kind"), beat.alias("name"), "label", F.lit(0).alias("rank"))
    for rank, (kind, name, label) in enumerate((("tool", "tool", F.col("tool")), ("target", "pair", F.substring("target", 1, 64))), 1):
        seen = seen.unionByName(calls.where(F.col(name).isNotNull()).select(key, "seq", "call", "beat", F.lit(kind).alias("kind"), F.col(name).alias("name"), label.alias("label"), F.lit(rank).alias("rank")))
    nodes = seen.groupBy(key, "kind", "name").agg(F.count("*").alias("refs"), F.countDistinct("beat").alias("beats"), F.min(place).alias("first"), F.min("label").alias("label"))
    weight = F.when((F.col("kind") == "target") & (F.col("beats") > 1), F.col("refs") + F.col("beats")).otherwise(F.col("refs"))
    order = Window.partitionBy(key).orderBy("first")
    nodes = nodes.select(key, "kind", "name", "label", weight.alias("weight"), "beats", F.row_number().over(order).cast("long").alias("node"))

    def edges(kind: str, rows: DataFrame, a, b) -> DataFrame:
        return rows.groupBy(key, a.alias("a"), b.alias("b")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit(kind))

    held, between = calls.where("pair IS NOT NULL"), (F.format_string("beat %d", "a"), F.format_string("beat %d", "b"))
    out = edges("spine", spine_edges(own, key), *between)
    out = out.unionByName(edges("call", calls, beat, F.col("tool"))).unionByName(edges("touch", held, F.col("tool"), F.col("pair")))
    return nodes, out.unionByName(edges("recurring", recurring_targets(held, key, "pair"), *between))


def graph_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("session_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("beat", "tool", "target")),
        F.count_if((F.col("kind") == "target") & (F.col("beats") > 1)).alias("recurring"),
    )


def heaviest(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.where("kind <> 'beat'").orderBy(F.col("weight").desc(), "session_id", "name").limit(limit)


def report(nodes: DataFrame, edges: DataFrame, truncated: bool) -> str:
    """One session's graph as text: totals, beats in order, tools by weight. For one file, whose lines are bounded."""
    rows, n_edges = nodes.orderBy("node").collect(), edges.agg(F.sum("weight").alias("n")).first()["n"] or 0
    of = {k: [r for r in rows if r["kind"] == k] for k in ("beat", "tool", "target")}
    again = sum(r["beats"] > 1 for r in of["target"])
    out = [
        f"{len(rows)} nodes — {len(of['beat'])} beats · {len(of['tool'])} tools · {len(of['target'])} targets",
        f"{n_edges} edges · {again} targets revisited by more than one beat",
    ]
    out += ["(tail only — file exceeded the graph read cap)"] * truncated
    out += [""] + [f"beat {r['node']}  {r['label']}" for r in of["beat"]]
    return "\n".join(out + [f"tool ×{r['weight']}  {r['label']}" for r in sorted(of["tool"], key=lambda r: -r["weight"])])
