"""Ranked text search over events: substring and token matching, BM25, filters, snippets.

One pass computes each phrase's occurrences; a one-row aggregate of it (rows, mean length, rows with
each phrase) is joined back by a broadcast of that row. Nothing but the top rows is sorted. Where an index is
kept, ``textindex`` answers the same searches from posting lists.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.query import ACCENTED, PLAIN, TOKEN, TextQuery, compile_query
from logloom.functions.scalar import contains_ci

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"), 1)


def tokens_of(phrase: str) -> list[str]:
    plain = phrase.translate(str.maketrans(ACCENTED, PLAIN)).lower()
    return re.findall(r"[^\W_]+", plain)


def _occurrences(query: TextQuery, phrase: str, last: bool, text: Column, toks: Column) -> Column:
    """How often a phrase stands in a row; overlapping ones count."""
    if query.engine == "substring":
        return F.regexp_count(F.lower(text), F.lit(f"(?={re.escape(phrase)})")).cast("double")
    words = tokens_of(phrase)
    if not words:
        return F.lit(0.0)
    prefix = last and query.prefix

    def same(token: Column, word: str, k: int) -> Column:
        return token.startswith(word) if prefix and k == len(words) - 1 else token == word

    if len(words) == 1:
        return F.size(F.filter(toks, lambda t: same(t, words[0], 0))).cast("double")
    places = F.when(F.size(toks) >= len(words), F.sequence(F.lit(1), F.size(toks) - len(words) + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(
        F.filter(places, lambda i: reduce(lambda a, b: a & b, (same(F.get(toks, i - 1 + k), w, k) for k, w in enumerate(words))))
    ).cast("double")


def bm25(phrases: list[tuple[Column, Column]], rows: Column, length: Column, mean_length: Column) -> Column:
    """The score of a row: phrases are (how often it stands here, rows that hold it); more negative is better."""
    total = F.lit(0.0)
    for f, df in phrases:
        idf = F.greatest(F.lit(LEAST_IDF), F.ln((rows - df + 0.5) / (df + 0.5)))
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean_length))
    return -total


def scored(events: DataFrame, query: TextQuery) -> DataFrame:
    """Matching rows of events and their score: BM25, more negative is better."""
    n = len(query.phrases)
    if not n:
        return events.where("false").withColumn("score", F.lit(0.0))
    base = events.withColumn("__toks", tokens(F.col("text"))) if query.engine == "token" else events.withColumn("__toks", F.lit(None).cast("array<string>"))
    length = F.greatest(F.char_length("text") - 2, F.lit(0)) if query.engine == "substring" else F.size("__toks")
    counted = base.select(
        *events.columns,
        length.cast("double").alias("__d"),
        *(_occurrences(query, p, k == n - 1, F.col("text"), F.col("__toks")).alias(f"__f{k}") for k, p in enumerate(query.phrases)),
    )
    stats = counted.agg(
        F.count("*").cast("double").alias("__n"),
        F.avg("__d").alias("__avg"),
        *(F.count_if(F.col(f"__f{k}") > 0).cast("double").alias(f"__n{k}") for k in range(n)),
    )
    score = bm25([(F.col(f"__f{k}"), F.col(f"__n{k}")) for k in range(n)], F.col("__n"), F.col("__d"), F.col("__avg"))
    hit = reduce(lambda a, b: a & b, (F.col(f"__f{k}") > 0 for k in range(n)))
    # stats is one row
    return counted.where(hit).join(F.broadcast(stats)).select(*events.columns, score.alias("score"))


def search(events: DataFrame, text: str, limit: int = 200, engine: str | None = None) -> DataFrame:
    """The best rows by (score, session_id, seq)."""
    return scored(events, compile_query(text, engine)).orderBy("score", "session_id", "seq").limit(limit)


def session_filter(project: str | None = None, tier: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Predicate over sessions joined with projects; the bounds of time are inclusive and lexical."""
    parts = [F.lit(True)]
    if project is not None:
        parts.append(contains_ci(F.col("cwd"), project) | contains_ci(F.col("dir_name"), project))
    if tier is not None:
        parts.append(F.col("file_tier") == tier)
    if since is not None:
        parts.append(F.col("started_at") >= since)
    if until is not None:
        parts.append(F.col("started_at") <= until)
    return reduce(lambda a, b: a & b, parts)


def search_filtered(events: DataFrame, sessions: DataFrame, text: str, limit: int | None = 200, engine: str | None = None, **filters: str | None) -> DataFrame:
    """search among the sessions that pass; counts for the score are of the whole corpus all the same. Without a limit: all
    hits, in no order."""
    kept = sessions.where(session_filter(**filters)).select(F.col("id").alias("session_id"), "session_uuid", "file_tier", "cwd", "dir_name", "started_at")
    hits = scored(events, compile_query(text, engine)).join(kept, "session_id")
    return hits if limit is None else hits.orderBy("score", "session_id", "seq").limit(limit)


def snippet(text: Column, phrase: str, around: int = 48) -> Column:
    """The first hit between « and », with what stands around it."""
    at = F.instr(F.lower(text), phrase.lower())
    n = len(phrase)
    left = F.substring(text, F.greatest(F.lit(1), at - around), F.least(F.lit(around), at - 1))
    return F.when(
        at > 0,
        F.concat(
            F.when(at > around + 1, "…").otherwise(""), left, F.lit("«"), F.substring(text, at, F.lit(n)), F.lit("»"),
            F.substring(text, at + n, F.lit(around)), F.when(F.char_length(text) > at + n - 1 + around, "…").otherwise(""),
        ),
    )


#: Code points of a fragment.
FRAGMENT = 96


def hit_patterns(query: TextQuery) -> list[str]:
    """A pattern for each phrase's hits; tokens are whole words, but for the end of a prefix."""
    out = []
    for k, phrase in enumerate(query.phrases):
        body = re.escape(phrase)
        if query.engine == "token":
            last = query.prefix and k == len(query.phrases) - 1
            body = rf"(?<![\p{{L}}\p{{N}}]){body}" + ("" if last else r"(?![\p{L}\p{N}])")
        out.append(body)
    return out


def best_fragment(text: Column, patterns: list[str], size: int = FRAGMENT) -> Column:
    """The stretch of a text that holds most phrases, then most hits, the first of those; all hits in it between « and ».
    Windows of two sizes are laid every size; the fragment begins a little before its window's first hit. Null without
    a hit."""
    any_hit = F.lit("(?iu)(" + "|".join(patterns) + ")")
    halves = [F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})(?=(.{{0,{size}}}))"), k) for k in (1, 2)]

    def judged(pair: Column, i: Column) -> Column:
        window = F.concat(pair["0"], pair["1"])
        counts = [F.regexp_count(window, F.lit(f"(?iu){p}")) for p in patterns]
        distinct = reduce(lambda a, b: a + b, ((c > 0).cast("int") for c in counts))
        return F.struct(distinct.alias("phrases"), reduce(lambda a, b: a + b, counts).alias("hits"), (-i).alias("before"), window.alias("window"))

    def shown(best: Column) -> Column:
        window, place = best["window"], -best["before"] * size
        start = F.greatest(F.lit(1), F.regexp_instr(window, any_hit) - size // 4)
        marked = F.regexp_replace(F.substr(window, start, F.lit(size)), any_hit, F.lit("«$1»"))
        more = place + start - 1 + size < F.char_length(text)
        return F.when(best["phrases"] > 0, F.concat(F.when(place + start > 1, "…").otherwise(""), marked, F.when(more, "…").otherwise("")))

    best = F.array_max(F.transform(F.arrays_zip(*halves), judged))
    return F.get(F.transform(F.array(best), shown), F.lit(0))  # the best window is found once


def score_summary(hits: DataFrame) -> DataFrame:
    """hits, top, spread, flat: whether the scores tell hits apart."""
    strength = F.abs("score")
    out = hits.agg(F.count("*").alias("hits"), F.max(strength).alias("top"), (F.max(strength) - F.min(strength)).alias("spread"))
    flat = (F.col("hits") > 1) & (F.col("top") > 0) & (F.try_divide("spread", "top") < 0.05)
    return out.withColumn("flat", F.coalesce(flat, F.lit(False)))


def substring_truth(events: DataFrame, needle: str) -> DataFrame:
    return events.where(contains_ci(F.col("text"), needle))
