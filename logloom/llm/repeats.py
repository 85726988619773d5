"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted twice, neighbours compared.

A suffix is kept where the hash of its first ``head`` words is the least of ``window`` such hashes in a
row. That depends on the words alone, so every run of head + window - 1 = 50 words or more that occurs
twice has a kept suffix at the same place of both. All kept suffixes are sorted by head, document and
place, across partitions; those whose head another one has are candidates. The suffixes at every word of
which the least head is a candidate are then sorted by their first 50 words, document and place, and each
that has an equal predecessor covers 50 words that occur earlier, whichever document has them. Covers that
overlap are one passage. The first occurrence of a passage has no predecessor and stays.

Words are compared as they are, by 64-bit hashes; a passage may draw on several earlier documents, and
every run of 50 words in it has occurred before. Documents are ordered by id, and those under one id by a
hash of the text; rows equal in both are one document. Null and empty texts and texts below 50 words have
no repeats; very long ones are read whole. Rows without an id are left alone. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, gathered, gram_hashes, mix64, only_in, pieces, read, unused
from .learn import words_of

LEAST = 50
HEAD = 26
WINDOW = LEAST - HEAD + 1
PARTITION_ROWS = 1 << 20
#: Documents with repeats whose places are broadcast at most.
BROADCAST_ROWS = 300_000


def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of n, by doubling."""
    width, out = 1, x
    while width * 2 <= n:
        out = f(out[:-width], out[width:])
        width *= 2
    return f(out[: len(x) - n + 1], out[n - width : len(x) - width + 1]) if n > width else out


def suffix_keys(heads: np.ndarray) -> np.ndarray:
    """What the least head of a window is told by."""
    return mix64(heads ^ np.uint64(0xA0761D6478BD642F))


def kept_suffixes(heads: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose value is the least of some window; ties are all kept."""
    if len(heads) < window:
        return np.zeros(0, np.int64)
    key = suffix_keys(heads)
    low = sliding(key, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, low, edge]), window, np.maximum) == key)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def suffixes(docs: DataFrame) -> DataFrame:
    """(head, doc_id, key, pos) of every kept suffix of docs (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                _, _, h, first, _, _ = words_of(batch.column("text"), fold=False)
                grams, ids, keys = gram_hashes(h, HEAD), batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
                heads, own, at = [], [], []
                for k in np.flatnonzero(np.diff(first) >= LEAST):
                    g = grams[first[k] : first[k + 1] - HEAD + 1]
                    pos = kept_suffixes(g)
                    heads.append(g[pos])
                    at.append(pos)
                    own.append(np.full(len(pos), k))
                if heads:
                    k = np.concatenate(own)
                    yield _batch(head=np.concatenate(heads).view(np.int64), doc_id=ids[k], key=keys[k], pos=np.concatenate(at).astype(np.int32))

    return docs.mapInArrow(run, "head long, doc_id long, key long, pos int")


def _repeated(kept: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, key, pos) of each suffix whose head stands at another place too, the first of them included.
    Every suffix sorted comes out of the comparison, with what it found; those without go after it."""
    columns = ("head", "doc_id", "key", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        like = False  # whether the held suffix has the head of the one before it

        def rows(edge: bool, twice: np.ndarray, c: list[np.ndarray]) -> pa.RecordBatch:
            return _batch(edge=np.full(len(twice), edge), twice=twice, **dict(zip(columns, c)))

        for batch in batches:
            c = [batch.column(k).to_numpy() for k in columns]
            if not len(c[0]):
                continue
            if last is None:  # its predecessor may be in another partition
                yield rows(True, np.ones(1, bool), [x[:1] for x in c])
            else:
                c = [np.append(x, y) for x, y in zip(last, c)]
            c = [x[_fresh(c)] for x in c]
            same = c[0][1:] == c[0][:-1]
            before, behind = np.append(like, same), np.append(same, False)
            last, like = [x[-1:] for x in c], bool(before[-1])
            yield rows(False, (before | behind)[:-1], [x[:-1] for x in c])  # the last one waits for its successor
        if last is not None:
            yield rows(True, np.ones(1, bool), last)
            yield rows(False, np.array([like]), last)

    found = gathered(
        kept.repartitionByRange(partitions, *columns)
        .sortWithinPartitions(*columns)
        .mapInArrow(run, "edge boolean, twice boolean, head long, doc_id long, key long, pos int")
        .where("twice")
        .drop("twice")
    )
    # two rows a partition
    edges = found.where("edge").select(*columns).distinct()
    several = edges.groupBy("head").agg(F.collect_list(F.struct(*columns[1:])).alias("x")).where(F.size("x") > 1).select(F.explode("x").alias("x")).select("x.*")
    out = found.where("NOT edge").select(*columns[1:]).unionByName(several)
    out._logloom_path = found._logloom_path
    return out


def _fresh(c: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the one before them."""
    out = np.ones(len(c[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in c], axis=0)
    return out


def _windows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(window, doc_id, key, at): the hash and place of each run of LEAST words whose least head is at a repeated suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                _, _, h, first, _, _ = words_of(batch.column("text"), fold=False)
                heads, ids, keys = gram_hashes(h, HEAD), batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
                windows = gram_hashes(h, LEAST)
                out, own, at = [], [], []
                for k in np.flatnonzero(np.diff(first) >= LEAST):
                    key = suffix_keys(heads[first[k] : first[k + 1] - HEAD + 1])
                    places = batch.column("places")[k].values.to_numpy()
                    some = np.full(len(key), ~np.uint64(0))
                    some[places] = key[places]
                    start = np.flatnonzero(sliding(some, WINDOW, np.minimum) == sliding(key, WINDOW, np.minimum))
                    out.append(windows[first[k] + start])
                    own.append(np.full(len(start), k))
                    at.append(start)
                if out:
                    k = np.concatenate(own)
                    yield _batch(window=np.concatenate(out).view(np.int64), doc_id=ids[k], key=keys[k], at=np.concatenate(at).astype(np.int32))

    wanted = repeated.groupBy("doc_id", "key").agg(F.collect_list("pos").alias("places"))
    return only_in(docs, "key", repeated).join(wanted, ["doc_id", "key"]).mapInArrow(run, "window long, doc_id long, key long, at int")


def _covered(windows: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, key, at, src): the windows that occur earlier, and the document that has them just before. Every
    window sorted comes out of the comparison; those without an earlier one go after it."""
    columns = ("window", "doc_id", "key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None

        def rows(edge: int, c: list[np.ndarray], src: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(src), edge, np.int32)), *(pa.array(x) for x in c), src], ["edge", *columns, "src"])

        for batch in batches:
            c = [batch.column(k).to_numpy() for k in columns]
            if not len(c[0]):
                continue
            if last is None:
                yield rows(1, [x[:1] for x in c], pa.array(c[1][:1]))
            else:
                c = [np.append(x, y) for x, y in zip(last, c)]
            c = [x[_fresh(c)] for x in c]
            last = [x[-1:] for x in c]
            same = c[0][1:] == c[0][:-1]
            yield rows(0, [x[1:] for x in c], pa.array(c[1][:-1], mask=~same))
        if last is not None:
            yield rows(2, last, pa.array(last[1]))

    found = gathered(
        windows.repartitionByRange(partitions, *columns)
        .sortWithinPartitions(*columns)
        .mapInArrow(run, "edge int, window long, doc_id long, key long, at int, src long")
        .where("src IS NOT NULL")
    )
    # two rows a partition; a lone window is first and last of its partition: its first row looks back
    order = Window.partitionBy("window").orderBy("doc_id", "key", "at", "edge")
    edges = found.where("edge > 0").select("edge", "doc_id", "key", "at", F.lag("doc_id").over(order).alias("src")).where("edge = 1 AND src IS NOT NULL")
    out = found.where("edge = 0").select(*columns[1:], "src").unionByName(edges.select(*columns[1:], "src"))
    out._logloom_path = found._logloom_path
    return out


def _spans(covered: DataFrame) -> DataFrame:
    """doc_id, key, start_word, n_words, source_id: windows of a document that overlap, made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # doc_id, key, start, stop, source

        def rows(spans: list) -> pa.RecordBatch:
            d, key, a, b, s = (np.array(c, np.int64) for c in zip(*spans))
            return _batch(doc_id=d, key=key, start_word=a, n_words=b - a, source_id=s)

        for batch in batches:
            d, key, p, s = (batch.column(k).to_numpy() for k in ("doc_id", "key", "at", "src"))
            if not len(d):
                continue
            fresh = _fresh([d, key])
            fresh[1:] |= p[1:] >= p[:-1] + LEAST
            if held is not None and held[:2] == [d[0], key[0]] and p[0] < held[3]:
                fresh[0] = False
            a = np.flatnonzero(fresh)
            if not fresh[0]:
                held[3] = int(p[(a[0] if len(a) else len(d)) - 1]) + LEAST
            if len(a):
                b = np.append(a[1:], len(d)) - 1
                spans = [held] if held is not None else []
                spans += [[int(d[i]), int(key[i]), int(p[i]), int(p[j]) + LEAST, int(s[i])] for i, j in zip(a, b)]
                held = spans.pop()
                if spans:
                    yield rows(spans)
        if held is not None:
            yield rows([held])

    return (
        covered.repartition("doc_id", "key")
        .sortWithinPartitions("doc_id", "key", "at")
        .mapInArrow(run, "doc_id long, key long, start_word long, n_words long, source_id long")
    )


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), start_word, n_words, source_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")).where("doc_id IS NOT NULL")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = gathered(suffixes(own))
    repeated = _repeated(kept, max(least, -(-kept.count() // PARTITION_ROWS)))
    windows = gathered(_windows(own, repeated))
    discard(repeated)
    discard(kept)
    covered = _covered(windows, max(least, -(-windows.count() // PARTITION_ROWS)))
    spans = gathered(_spans(covered))
    discard(covered)
    discard(windows)
    return spans


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, source_id: each passage of LEAST words or more that occurs earlier, by (doc_id, place)."""
    return _found(docs).drop("key")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut out of the text (its first occurrence stays) and n_chars set
    anew. Texts that lose all of their words leave; the others' columns and order of words stay."""
    cut, i, k = (unused(docs, name) for name in ("cut", "other_id", "other_key"))
    spans = _found(docs).groupBy(F.col("doc_id").alias(i), F.col("key").alias(k)).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(cut))
    same = (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(k))
    spans = gathered(spans)
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # some tens of bytes a row: the texts stay where they are
        spans = F.broadcast(spans)
    joined = docs.join(spans, same, "left").drop(i, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                cuts = batch.column(cut).to_pylist()
                texts, gone = batch.column("text").to_pylist(), []
                _, at, h, first, begin, end = words_of(batch.column("text"), fold=False)
                for k, spans in enumerate(cuts):
                    if not spans:
                        continue
                    raw, rest, pos = texts[k].encode(), [], 0
                    left = first[k + 1] - first[k]
                    for c in spans:
                        a, n = c["start_word"], c["n_words"]
                        rest.append(raw[pos : begin[first[k] + a] - at[k]])
                        pos, left = int(end[first[k] + a + n - 1] - at[k]), left - n
                    texts[k] = (b"".join(rest) + raw[pos:]).decode()
                    if left <= 0:
                        gone.append(k)
                names = [n for n in batch.schema.names if n != cut]
                columns = [pa.array(texts, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names]
                mask = np.ones(batch.num_rows, bool)
                mask[gone] = False
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(mask))

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))
