"""Learned quality rules: an ordered list of threshold conjunctions, emitted as one Spark CASE expression.

Every statistic is a DataFrame expression over the whole text; no Python runs on the executors. The
rules are learned by sequential covering from the statistics of a bounded sample of labelled rows
(``sample``): a rule grows by the threshold with the best gain until it holds no wanted text, is pruned
on rows kept aside, and the rows it covers leave before the next rule is learned.

Null texts count as texts without words and fail the base rules, as do empty ones; very long ones are counted
whole, in the same way. Repeated rows and rows without an id are judged each on its
own. Without labels, or with one kind only, there are no rules and the base decides. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, read

SAMPLE = 6000


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts and a few more, for each row."""
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    ).select("doc_id", "t", barrier(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x != '')").alias("w"))
    # the windows of three words, by hash and position: equal ones stand side by side
    keys = words.select(
        "*", barrier("CASE WHEN size(w) >= 3 THEN sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS p))) END").alias("k")
    )
    # windows that equal a neighbour in that order: their positions, in the text's order
    same = "k[{j}].h = x.h AND w[x.p] = w[k[{j}].p] AND w[x.p + 1] = w[k[{j}].p + 1] AND w[x.p + 2] = w[k[{j}].p + 2]"
    equal = f"(j > 0 AND {same.format(j='j - 1')}) OR (j < size(k) - 1 AND {same.format(j='j + 1')})"
    found = keys.select(
        "*", barrier(f"CASE WHEN k IS NULL THEN CAST(array() AS ARRAY<INT>) ELSE sort_array(transform(filter(k, (x, j) -> {equal}), x -> x.p)) END").alias("p")
    )
    lines = F.expr(r"filter(split(t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')")
    return found.select("doc_id", "t", "w", "p", lines.alias("lines")).select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, j) -> IF(j = 0, 3, least(3, x - p[j - 1]))), 0L, (a, b) -> a + b)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"[!?]")).cast("long").alias("n_shouts"),
        F.regexp_count("t", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules look at: ratios of the statistics (what, per what).
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "distinct_word_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "shouts_per_word": ("n_shouts", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "n_words": ("n_words", None),
}


def features() -> dict[str, Column]:
    return {k: F.col(a).cast("double") if b is None else F.col(a) / F.greatest(F.col(b), F.lit(1)) for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(f"__{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def learn(rows: list[tuple[list[float], int]], cuts: int = 32, most_rules: int = 12, precision: float = 0.97) -> list[list[Literal]]:
    """Rules for label 0, in order, from (features, label). Sets of rows are the bits of an integer."""
    n = len(rows)
    bad = sum(1 << k for k, (_, y) in enumerate(rows) if y == 0)
    good = (1 << n) - 1 ^ bad
    if not bad or not good:
        return []
    aside = sum(1 << k for k in range(2, n, 3))  # rows come in hash order
    literals: dict[Literal, int] = {}
    for f, name in enumerate(FEATURES):
        values = sorted({x[f] for x, _ in rows})
        middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
        ranked = sorted(x[f] for x, _ in rows)
        if len(middles) > cuts:
            # by rank among the rows of either label, so that rare values of label 0 get cuts too
            wanted = set()
            for y in (0, 1):
                own = sorted(x[f] for x, label in rows if label == y)
                wanted |= {own[i * (len(own) - 1) // cuts] for i in range(cuts + 1)}
            wanted |= {ranked[-1]}
            middles = sorted({m for a, m in zip(values, middles) if a in wanted})
        for cut in middles:
            above = sum(1 << k for k, (x, _) in enumerate(rows) if x[f] > cut)
            literals[Literal(name, True, cut)] = above
            literals[Literal(name, False, cut)] = (1 << n) - 1 ^ above
    rules: list[list[Literal]] = []
    left = (1 << n) - 1
    while len(rules) < most_rules and (left & bad & ~aside):
        rule: list[Literal] = []
        held = left & ~aside
        while (negatives := (held & good).bit_count()) and len(rule) < 4:
            positives = (held & bad).bit_count()
            before = math.log2(positives / (positives + negatives))
            best, gain = None, 1e-9
            for literal, own in literals.items():
                p = (held & own & bad).bit_count()
                if p:
                    g = p * (math.log2(p / (p + (held & own & good).bit_count())) - before)
                    if g > gain:
                        best, gain = literal, g
            if best is None:
                break
            rule.append(best)
            held &= literals[best]
        if not rule:
            break

        def worth(part: list[Literal]) -> float:
            own = left & aside
            for literal in part:
                own &= literals[literal]
            p, q = (own & bad).bit_count(), (own & good).bit_count()
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = left
        for literal in rule:
            covered &= literals[literal]
        p, q = (covered & bad).bit_count(), (covered & good).bit_count()
        if p < 3 or p < precision * (p + q):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[list[Literal]]) -> Column:
    """The number of the first rule that a row of features meets; 0: none, the text is kept."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        condition = rules[k - 1][0].column()
        for literal in rules[k - 1][1:]:
            condition &= literal.column()
        out = F.when(condition, F.lit(k)).otherwise(out)
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, bound: int) -> list[tuple[list[float], int]]:
    """(features, label) of at most ``bound`` labelled rows, half of them of each label, by a hash of doc_id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    order = F.xxhash64("doc_id", F.lit(29))
    half = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(bound // 2) for y in (0, 1)]
    ids = half[0].unionByName(half[1])  # at most ``bound`` rows of two numbers
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    rows = (
        with_statistics(own)
        .select("doc_id", *(v.alias(k) for k, v in features().items()))
        .join(F.broadcast(ids), "doc_id")
        .select(order.alias("o"), F.array(*FEATURES).alias("x"), "y")
        .orderBy("o", "x")
        .limit(bound)
        .collect()
    )
    return [(list(r["x"]), r["y"]) for r in rows]


_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and base_failed."""
    return with_statistics(docs).select("doc_id", *BASE, F.expr(_FAILED).alias("base_failed"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the number of the rule that rejects (0: none)."""
    rules = learn(sample_rows(docs, labels, sample))
    counted = with_statistics(docs).select("*", *(v.alias(f"__{k}") for k, v in features().items()))
    return counted.select("doc_id", *BASE, F.expr(_FAILED).alias("base_failed"), verdict(rules).alias("rule")).select("*", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
