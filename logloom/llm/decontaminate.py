"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

DataFrame expressions only. A window that shares no five-word shingle with an item has similarity 0 to
it, so only windows laid so that a shared shingle falls on its place in the item are fingerprinted: of
the item's size, inside the text. Fingerprints of 64 bits are cut into RADIUS + 1 blocks; two that
differ in RADIUS bits at most agree in one block, so joining on (size, block, value) finds them all. What
is found is verified by the exact weighted similarity: sum of least over sum of greatest multiplicity of
each shingle, 0.75 or more.

Words are lower-cased. Texts or items with one to four words have their whole sequence as the one
shingle, so that such an item is found only in a text that is just it; null and empty ones match nothing,
very long ones are read whole. Repeated rows of either table add nothing to a pair. Texts under one id are
documents of their own; of a pair of ids the best window of any is told. Documents without an id are not told of,
but they are screened where leaks are taken out; items without an id are ignored. Columns other than the ids and
texts are ignored. An empty table of either kind gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, materialise, read, unused

SHINGLE = 5
PERCENT = 75
RADIUS = 20
#: Rows of a side that is broadcast at most (16 to 24 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingled(table: DataFrame, key: str) -> DataFrame:
    """(key, n, shs) of (key, text): words and hashes of the shingles in order. Outer explodes below: others bring
    filters on the array, which the optimizer would push down."""
    words = table.select(
        key,
        barrier(r"filter(split(lower(coalesce(CAST(text AS STRING), '')), '[\\x20\\x09-\\x0D]+'), x -> x != '')").alias("w"),
    )
    return words.select(
        key,
        F.size("w").alias("n"),
        barrier(
            f"""CASE WHEN size(w) = 0 THEN CAST(array() AS ARRAY<BIGINT>) WHEN size(w) < {SHINGLE} THEN array(xxhash64(array_join(w, ' ')))
                ELSE transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END"""
        ).alias("shs"),
    )


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fingerprints(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp: the SimHash of shs; a shingle counts as often as it stands there."""
    each = table.select(*keys, F.explode_outer("shs").alias("sh"))
    sums = each.groupBy(*keys).agg(*(F.sum(F.expr(f"2 * int(shiftrightunsigned(sh, {b}) & 1) - 1")).alias(f"b{b}") for b in range(64)))
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.expr(f"IF(b{b} > 0, shiftleft(1L, {b}), 0L)"))
    return sums.select(*keys, fp.alias("fp"))


def _blocks(prints: DataFrame) -> DataFrame:
    """A row a block of each fingerprint."""
    cuts = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    parts = ", ".join(f"struct({k} AS block, shiftrightunsigned(fp, {a}) & {(1 << b - a) - 1}L AS value)" for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return prints.select("*", F.explode(F.expr(f"array({parts})")).alias("x")).select(*prints.columns, "x.block", "x.value")


def _numbered(table: DataFrame, column: str, name: str) -> DataFrame:
    """table with ``name``: the shingles of ``column``, repeats numbered, so that sets of the results count
    multiplicities. Sorted, then run by run: linear but for the sort."""
    sorted_ = table.select("*", barrier(f"array_sort({column})").alias("srt"))
    runs = sorted_.select("*", barrier("filter(sequence(0, size(srt) - 1), i -> i = 0 OR srt[i] <> srt[i - 1])").alias("runs"))
    each = "transform(sequence(0, IF(j + 1 < size(runs), runs[j + 1], size(srt)) - a - 1), r -> xxhash64(srt[a], r))"
    return runs.select("*", barrier(f"flatten(transform(runs, (a, j) -> {each}))").alias(name)).drop("srt", "runs")


def document(docs: DataFrame) -> Column:
    """What a document is known by: its id and a hash of its text. A struct, whose null id is equal to a null id."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text"))


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(d, item_id, start, size, similarity): every window of a document (d, as ``document`` has it) that holds an item."""
    read_items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = materialise(shingled(read_items, "item_id").dropDuplicates(["item_id", "shs"])).where("n > 0")
    at = items.select("item_id", "n", F.posexplode_outer("shs").alias("offset", "sh"))
    own = docs.select(document(docs).alias("d"), "text")
    texts = shingled(own, "d")

    # documents' shingles that an item has, and the windows they suggest
    hits = texts.select("d", F.col("n").alias("words"), F.posexplode_outer("shs").alias("pos", "sh")).join(_small(at.select("sh").distinct()), "sh")
    suggested = hits.join(_small(at), "sh").select(
        "d",
        F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("words") - F.col("n"))).alias("start"),
        F.col("n").alias("size"),
    )
    windows = materialise(suggested.distinct())
    wanted = _small(windows.select("d").distinct())
    # only the documents with windows are shingled again
    laid = (
        shingled(own.join(wanted, "d", "left_semi"), "d")
        .join(windows, "d")
        .select("d", "start", "size", F.expr(f"slice(shs, start + 1, greatest(least(size, n) - {SHINGLE - 1}, 1))").alias("shs"))
        .select("*", F.xxhash64("shs", F.lit(1)).alias("u"), F.xxhash64("shs", F.lit(2)).alias("v"))
    )
    laid = materialise(laid)
    # equal windows are fingerprinted and compared once
    unique = materialise(laid.groupBy("size", "u", "v").agg(F.first("shs").alias("shs")))
    prints = fingerprints(unique, ["size", "u", "v"])
    of_items = fingerprints(items.select("item_id", F.col("n").alias("size"), F.xxhash64("shs").alias("i"), "shs"), ["item_id", "size", "i"])
    near = (
        _blocks(prints)
        .join(_small(_blocks(of_items).withColumnRenamed("fp", "item_fp")), ["size", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        .select("size", "u", "v", "item_id", "i")
        .distinct()
    )
    sides = near.join(unique, ["size", "u", "v"]).join(
        _small(items.select("item_id", F.xxhash64("shs").alias("i"), F.col("shs").alias("item_shs"))), ["item_id", "i"]
    )
    numbered = _numbered(_numbered(sides, "shs", "a"), "item_shs", "b")
    exact = (
        numbered.select("size", "u", "v", "item_id", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("sum"))
        .where(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both")))
        .select("size", "u", "v", "item_id", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))
    )
    return laid.select("d", "start", "size", "u", "v").join(exact, ["size", "u", "v"]).select("d", "item_id", "start", "size", "similarity")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document that holds an item."""
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"), F.col("size").alias("z"))).alias("m")
    named = found(docs, benchmark).where("d.doc_id IS NOT NULL").groupBy(F.col("d.doc_id").alias("doc_id"), "item_id").agg(best)
    return named.select(
        "doc_id", "item_id", (-F.col("m.s")).cast("long").alias("start_word"), F.col("m.z").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item."""
    name = unused(docs, "leaking")
    bad = _small(materialise(found(docs, benchmark).select(F.col("d").alias(name)).distinct()))
    return docs.join(bad, document(docs) == bad[name], "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
