"""Five corpus stages in a row: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again for the next, and deletes what no later
stage reads.

In every stage rows without text count as empty, very long texts are handled whole, rows without an id and
texts under one id are documents of their own, extra columns are carried along whatever they are called, and
an empty table gives an empty one. Rows equal in id and text are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import discard, materialise, read, unused
from logloom.llm.decontaminate import without_leaks
from logloom.llm.jaccard import one_of_each
from logloom.llm.packing import pack
from logloom.llm.quality import CUT, with_quality
from logloom.llm.repeats import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. Rows without text are scored as empty ones."""
    score = unused(docs, "score")
    return with_quality(docs, read(spark, sf_dir, "labels"), score).where(F.col(score) >= CUT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links hold together: that with the smallest id, rows
    without an id last. Texts without a word link with nothing and all stay."""
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents without a word left go."""
    return without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

#: Classifier, links and packing have no SQL form; the tests compare small runs with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return docs
