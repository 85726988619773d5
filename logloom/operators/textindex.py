"""A kept text index: posting lists by token and by run of three code points, with the places of each.

A posting row is a term in an event: how long the event is and where the term stands. Rows lie in PARTS parts of
each kind, by the term's first two code points (tokens, so that a prefix of two is in one part) or by the whole run,
sorted by term: a search reads the parts of its terms, and of them the row groups that can hold one. An import
appends a segment with the postings of the sessions it touched; INDEXED tells each session's segment, and with it
which postings still count. So nothing that was written before is rewritten until the index is compacted.

A phrase is found by its rarest term first: the events that have it, if they are few, are what the other terms'
postings are read down to; places then tell how often the phrase stands there. Scores equal those of
``search.scored``, which reads all texts. Null texts count as empty. Events are told apart by session and number, of which
every pair stands for one event, as a store keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.query import TextQuery
from logloom.operators.search import bm25, tokens, tokens_of

PARTS = 64
#: A part is written by so many tasks at most: a run of blanks stands in nearly every text.
SALTS = 8
GRAM = 3
#: Bytes of text whose terms are grouped at a time.
SLICE = 1 << 20
#: Events of the rarest term that are broadcast at most.
BROADCAST_ROWS = 1_000_000
KINDS = {"substring": "gram", "token": "token"}


def part_of(kind: str, term: str) -> int:
    return zlib.crc32((term[:2] if kind == "token" else term).encode()) % PARTS


def lengths(events: DataFrame) -> DataFrame:
    """events (session_id, seq, text) with their tokens, and their lengths as either kind counts them."""
    text = F.coalesce("text", F.lit(""))
    return events.select("session_id", "seq", text.alias("text"), tokens(text).alias("tokens"), F.greatest(F.char_length(text) - (GRAM - 1), F.lit(0)).alias("grams"))


def indexed(events: DataFrame, segment: int) -> DataFrame:
    """A row a session: its segment, events and lengths."""
    own = lengths(events)
    return own.groupBy("session_id").agg(
        F.lit(segment).cast("long").alias("segment"), F.count("*").alias("n_rows"), F.sum(F.size("tokens")).alias("token_length"), F.sum("grams").alias("gram_length")
    )


def _grouped(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which equal (row, term) stand together, as they came, and where each group begins (one more entry:
    the end)."""
    order = np.lexsort((np.arange(len(row)), term, row))
    r, t = row[order], term[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    return order, np.append(np.flatnonzero(fresh), len(r))


def _rows(kind: str, batch: pa.RecordBatch, row: np.ndarray, term: np.ndarray, place: np.ndarray, names: Callable[[np.ndarray], pa.Array], length: str) -> pa.RecordBatch:
    """A row a term of an event, with its places."""
    order, first = _grouped(row, term)
    heads = order[first[:-1]]
    own = pa.array(row[heads])
    places = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(place[order].astype(np.int32)))
    columns = [pa.repeat(kind, len(heads)), names(term[heads]), batch.column("session_id").take(own), batch.column("seq").take(own), batch.column(length).take(own), places]
    return pa.RecordBatch.from_arrays(columns, ["kind", "term", "session_id", "seq", "d", "places"])


def _gram_names(codes: np.ndarray) -> pa.Array:
    points = np.column_stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]).astype("<u4")
    text = points.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of (session_id, seq, low, tokens, n_tokens, grams), grouped event by event, some SLICE bytes at a time."""
    for whole in batches:
        size = np.cumsum(pc.binary_length(whole.column("low")).to_numpy(zero_copy_only=False))
        a = 0
        while a < whole.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE, "right")))
            batch = whole.slice(a, b - a)
            a = b
            tokens, n = batch.column("tokens"), batch.column("n_tokens").to_numpy().astype(np.int64)
            if n.sum():
                coded = tokens.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield _rows("token", batch, row, coded.indices.to_numpy().astype(np.int64), place, lambda t, d=coded.dictionary: d.take(pa.array(t)), "n_tokens")
            points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for t in batch.column("low").to_pylist()]
            each = [p[:-2] << 42 | p[1:-1] << 21 | p[2:] for p in points if len(p) >= GRAM]
            if each:
                row = np.repeat([k for k, p in enumerate(points) if len(p) >= GRAM], [len(x) for x in each])
                yield _rows("gram", batch, row, np.concatenate(each), np.concatenate([np.arange(len(x)) for x in each]), _gram_names, "grams")


def postings(events: DataFrame, segment: int) -> DataFrame:
    """The posting rows of events, each part in SALTS tasks at most, sorted by term. Places are grouped where a text is
    read, so that what is shuffled is a row a term of an event."""
    own = lengths(events)
    read = own.select("session_id", "seq", F.lower("text").alias("low"), "tokens", F.size("tokens").alias("n_tokens"), "grams")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    each = read.mapInArrow(_terms, f"kind string, term string, session_id {kinds['session_id']}, seq {kinds['seq']}, d int, places array<int>")
    key = F.when(F.col("kind") == "token", F.substr("term", F.lit(1), F.lit(2))).otherwise(F.col("term"))
    dealt = each.select("*", (F.crc32(key.cast("binary")) % PARTS).cast("int").alias("part"))
    rows = dealt.repartition("kind", "part", F.pmod(F.xxhash64("session_id", "seq"), F.lit(SALTS)))
    return rows.select("kind", "part", F.lit(segment).cast("long").alias("segment"), "term", "session_id", "seq", "d", "places").sortWithinPartitions(
        "kind", "part", "term", "session_id", "seq"
    )


@dataclass(frozen=True)
class Slot:
    """A term of a phrase, how far from the phrase's begin it stands, and whether it may go on."""

    term: str
    offset: int
    prefix: bool = False

    def matches(self) -> Column:
        return F.col("term").startswith(self.term) if self.prefix else F.col("term") == self.term


def slots_of(query: TextQuery, k: int) -> list[Slot]:
    """The terms that make up the k-th phrase: tokens side by side, or runs that cover it."""
    phrase = query.phrases[k]
    if query.engine == "token":
        words = tokens_of(phrase)
        last = query.prefix and k == len(query.phrases) - 1
        return [Slot(w, i, last and i == len(words) - 1) for i, w in enumerate(words)]
    starts = sorted({*range(0, len(phrase) - GRAM + 1, GRAM), len(phrase) - GRAM})
    return [Slot(phrase[i : i + GRAM], i) for i in starts]


def rows_of(postings: DataFrame, kind: str, slots: list[Slot]) -> DataFrame:
    """The posting rows of the slots' terms; only their parts are read."""
    own = postings.where(F.col("kind") == kind)
    if all(len(s.term) >= 2 or not s.prefix for s in slots):
        own = own.where(F.col("part").isin(sorted({part_of(kind, s.term) for s in slots})))
    return own.where(reduce(lambda a, b: a | b, (s.matches() for s in slots)))


EVENT = ("session_id", "seq", "segment")


def _phrase(postings: DataFrame, kind: str, slots: list[Slot], counts: list[int]) -> DataFrame:
    """EVENT, f and d of the events that hold a phrase."""
    rows = rows_of(postings, kind, slots)
    rare = min(range(len(slots)), key=lambda k: counts[k])
    if len(slots) > 1 and counts[rare] <= BROADCAST_ROWS:
        having = rows_of(postings, kind, [slots[rare]]).select(*EVENT).distinct()
        rows = rows.join(F.broadcast(having), list(EVENT), "left_semi")
    places = [F.flatten(F.collect_list(F.when(s.matches(), F.col("places")))).alias(f"p{k}") for k, s in enumerate(slots)]  # one event
    found = rows.groupBy(*EVENT).agg(*places, F.max("d").alias("d"))
    starts = [F.expr(f"transform(p{k}, x -> x - {s.offset})") for k, s in enumerate(slots)]
    return found.select(*EVENT, F.size(reduce(F.array_intersect, starts)).cast("double").alias("f"), "d").where("f > 0")


def scored(postings: DataFrame, sessions: DataFrame, query: TextQuery) -> DataFrame:
    """(session_id, seq, score) of the events that hold all phrases. sessions: INDEXED."""
    kind, n = KINDS[query.engine], len(query.phrases)
    phrases = [slots_of(query, k) for k in range(n)]
    empty = postings.where("false").select("session_id", "seq", F.lit(0.0).alias("score"))
    if not n or not all(phrases):
        return empty
    flat = [s for slots in phrases for s in slots]
    counts = list(rows_of(postings, kind, flat).agg(*(F.count_if(s.matches()).alias(f"c{k}") for k, s in enumerate(flat))).first())
    if not all(counts):
        return empty
    parts, at = [], 0
    for k, slots in enumerate(phrases):
        parts.append(_phrase(postings, kind, slots, counts[at : at + len(slots)]).select(*EVENT, F.lit(k).alias("k"), "f", "d"))
        at += len(slots)
    each = reduce(DataFrame.unionByName, parts)
    held = each.groupBy(*EVENT).agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("f"))), F.lit(0.0)).alias(f"f{k}") for k in range(n)), F.max("d").cast("double").alias("d"))
    live = held.join(sessions.select("session_id", "segment"), ["session_id", "segment"], "left_semi")
    size = sessions.agg(F.sum("n_rows").cast("double").alias("n"), (F.sum(f"{kind}_length") / F.sum("n_rows")).alias("avg"))
    with_phrase = live.agg(*(F.count_if(F.col(f"f{k}") > 0).cast("double").alias(f"n{k}") for k in range(n)))
    hit = reduce(lambda a, b: a & b, (F.col(f"f{k}") > 0 for k in range(n)))
    # one row each
    told = live.where(hit).join(F.broadcast(size)).join(F.broadcast(with_phrase))
    return told.select("session_id", "seq", bm25([(F.col(f"f{k}"), F.col(f"n{k}")) for k in range(n)], F.col("n"), F.col("d"), F.col("avg")).alias("score"))


def search_many(postings: DataFrame, sessions: DataFrame, queries: list[tuple[int, TextQuery]], limit: int = 200) -> DataFrame:
    """(query_id, session_id, seq, score, rank): the best events of each of many searches, of either engine, in one plan:
    the queries' terms are a table that the postings are joined with once. At most BROADCAST_ROWS terms in all."""
    spark = postings.sparkSession
    rows = []
    for query_id, query in queries:
        phrases = [slots_of(query, k) for k in range(len(query.phrases))]
        if all(phrases):
            rows += [(query_id, len(phrases), KINDS[query.engine], k, len(slots), s.term, s.offset, s.prefix) for k, slots in enumerate(phrases) for s in slots]
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"at most {BROADCAST_ROWS} terms in one search")
    asked = spark.createDataFrame(rows, "query_id int, n_phrases int, kind string, k int, n_slots int, term string, offset int, prefix boolean")
    wanted = F.broadcast(asked.where("NOT prefix").drop("prefix"))
    if any(r[-1] for r in rows):
        begun = asked.where("prefix").drop("prefix").withColumnRenamed("term", "begin").drop("kind")
        known = postings.where("kind = 'token'").select("kind", "term").distinct()
        # as many rows as terms begin so: Spark chooses how to join them
        wanted = asked.where("NOT prefix").drop("prefix").unionByName(known.join(F.broadcast(begun), F.col("term").startswith(F.col("begin"))).drop("begin"))
    parts = sorted({part_of(r[2], r[5]) for r in rows if not (r[-1] and len(r[5]) < 2)})
    read = postings if any(r[-1] and len(r[5]) < 2 for r in rows) else postings.where(F.col("part").isin(parts))
    live = read.join(wanted, ["kind", "term"]).join(sessions.select("session_id", "segment"), ["session_id", "segment"], "left_semi")
    # a phrase begins where all of its slots say so
    by = ("query_id", "k", "session_id", "seq")
    begins = F.flatten(F.collect_list(F.expr("transform(places, x -> x - offset)")))  # of one event
    rest = [F.first(c).alias(c) for c in ("n_slots", "n_phrases", "kind", "d")]
    held = live.groupBy(*by).agg(F.array_sort(begins).alias("s"), *rest).where("size(s) >= n_slots")
    counted = held.select(*by, "n_phrases", "kind", F.col("d").cast("double").alias("d"), F.expr("size(filter(sequence(0, size(s) - n_slots), i -> s[i] = s[i + n_slots - 1]))").cast("double").alias("f"))
    found = counted.where("f > 0")
    having = found.groupBy("query_id", "k").agg(F.count("*").cast("double").alias("df"))  # a row a phrase
    size = sessions.agg(F.sum("n_rows").cast("double").alias("n"), *((F.sum(f"{kind}_length") / F.sum("n_rows")).alias(f"{kind}_avg") for kind in KINDS.values()))
    mean = F.when(F.col("kind") == "gram", F.col("gram_avg")).otherwise(F.col("token_avg"))
    each = found.join(F.broadcast(having), ["query_id", "k"]).join(F.broadcast(size))
    scores = each.select("query_id", "session_id", "seq", "n_phrases", bm25([(F.col("f"), F.col("df"))], F.col("n"), F.col("d"), mean).alias("part"))
    total = scores.groupBy("query_id", "session_id", "seq").agg(F.sum("part").alias("score"), F.count("*").alias("found"), F.first("n_phrases").alias("n_phrases")).where("found = n_phrases")
    # Spark keeps the first rows of each query in every task before it shuffles them
    order = Window.partitionBy("query_id").orderBy("score", "session_id", "seq")
    best = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("query_id", "session_id", "seq", "score", F.col("rank").cast("long").alias("rank"))
