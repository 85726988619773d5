"""Chunks of texts in scripts without blanks, and words learned from a corpus of such texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.language import HAN, KANA, THAI, Lattice, windows

#: Gives the (begin, end) of a text's words. Any function will do; it is sent to the executors.
Segmenter = Callable[[str], list[tuple[int, int]]]
_default: list[Lattice] = []


def lattice(text: str) -> list[tuple[int, int]]:
    """The segmenter with the words that are known from the start; one table a worker."""
    if not _default:
        _default.append(Lattice())
    return _default[0].ranges(text)


def segmented_chunks(events: DataFrame, segmenter: Segmenter, words: int, stride: int, most: int) -> DataFrame:
    """events (text, ...) with chunk_index and text a chunk, instead of their text. Runs of blanks count as one. Rows stay
    whole in Arrow batches of their own text's size."""
    rest = [f for f in events.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "chunk_index long, text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, out = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                whole = " ".join((text or "").split())
                for j, chunk in enumerate(windows(whole, segmenter(whole), words, stride, most)):
                    rows.append(k)
                    index.append(j)
                    out.append(chunk)
            kept = batch.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(index, pa.int64()), pa.array(out, pa.string())], [*kept.schema.names, "chunk_index", "text"])

    return events.select(*(f.name for f in rest), "text").mapInArrow(run, schema)


def learn_words(events: DataFrame, least: int = 5, longest: int = 6, cohesion: float = 3.0) -> DataFrame:
    """(word, count): strings of 2 to ``longest`` letters of unspaced scripts that stand ``least`` times or more, and
    ``exp(cohesion)`` times as often as their parts would by chance, however they are cut in two. Counts are aggregated
    before they are shuffled; a string is joined with its parts by themselves."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{THAI}]+|[{KANA}{HAN}]+)"), 1))
    runs = events.select(run.alias("r"))
    strings = F.expr(f"flatten(transform(sequence(1, {longest}), n -> regexp_extract_all(r, concat('(?s)(?=(.{{', n, '}}))'), 1)))")
    counted = runs.select(F.explode(strings).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    known = counted.where(F.col("count") >= least)
    letters = counted.where(F.char_length("word") == 1).agg(F.sum("count").alias("letters"))  # one row
    cuts = known.where(F.char_length("word") > 1).select("word", "count", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("cut"))
    halves = cuts.select("word", "count", F.substr("word", F.lit(1), F.col("cut")).alias("a"), F.substr("word", F.col("cut") + 1).alias("b"))
    part = lambda n: known.select(F.col("word").alias(n), F.col("count").alias(f"n_{n}"))
    told = halves.join(part("a"), "a").join(part("b"), "b").join(F.broadcast(letters))
    bond = F.ln(F.col("count") * F.col("letters") / (F.col("n_a") * F.col("n_b")))
    return told.groupBy("word", "count").agg(F.min(bond).alias("bond")).where(F.col("bond") >= cohesion).select("word", "count")
