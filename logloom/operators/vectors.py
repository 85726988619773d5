"""Chunk vectors: providers, validation, centring, exact semantic search, coverage.

The query side is a handful of rows and is broadcast. Vectors are arrays of floats or packed little-endian
float32 (which Arrow hands over without a copy), and are read by class and model partitions: once for their
mean, of which each task gives one partial sum, and once as matrices multiplied with the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StructField, StructType

from logloom.functions.language import dominant
from logloom.functions.scalar import vector_class
from logloom.operators.segment import Segmenter, lattice
from logloom.operators.sequence import chunks, keep_best

TINY = 1e-6
#: Chunks of one event that are embedded unless another number is asked for.
MOST_CHUNKS = 32
#: Languages that models are told apart by; any other text counts as the first's.
LANGUAGES = ("en", "th", "zh-Hans", "ja")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


@F.pandas_udf(BinaryType())
def pack(vectors: pd.Series) -> pd.Series:
    """Arrays as little-endian float32."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def unpack(blobs: pd.Series) -> pd.Series:
    """Packed vectors as arrays; null where the bytes are not whole floats."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers in a row, where each vector begins; one more entry: the end). Null: empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            return np.zeros(0, np.float32), np.zeros(1, np.int64)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        return raw.view("<f4"), (at - at[0]) // 4
    at = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors of dim numbers as a matrix of doubles, their rows)."""
    flat, at = _rows(column)
    own = np.flatnonzero(np.diff(at) == dim)
    if len(own) == len(at) - 1:
        return flat.reshape(-1, dim).astype(np.float64), own
    return flat[at[own][:, None] + np.arange(dim)].astype(np.float64) if len(own) else np.zeros((0, dim)), own


def _sums(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts, place by place, of the vectors in the batches' first column."""
    sums, counts = np.zeros(0), np.zeros(0, np.int64)
    for batch in batches:
        flat, at = _rows(batch.column(0))
        size = np.diff(at)
        dim = int(size.max(initial=0))
        if dim > len(sums):
            sums, counts = (np.pad(x, (0, dim - len(x))) for x in (sums, counts))
        if dim and (size == dim).all():
            sums[:dim] += flat.reshape(-1, dim).sum(0, dtype=np.float64)
            counts[:dim] += len(size)
        elif dim:
            place = np.arange(len(flat)) - np.repeat(at[:-1], size)
            sums[:dim] += np.bincount(place, flat, dim)
            counts[:dim] += np.bincount(place, minlength=dim)
    return sums, counts


def vector_sums(vectors: DataFrame, *keys: str, column: str = "vector") -> DataFrame:
    """(keys, sums, counts): mergeable statistics of the vectors of each key: adding place by place joins two. A task
    gives one row for each key that it meets; keys are few (classes and models)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            for key in set(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else {()}:
                part = own
                for k, value in zip(keys, key):
                    part = part.filter(pc.is_null(part[k]) if value is None else pc.equal(part[k], value))
                sums, counts = _sums(part.select([column]).combine_chunks().to_batches())
                a, n = held.get(key, (np.zeros(0), np.zeros(0, np.int64)))
                dim = max(len(a), len(sums))
                grown = lambda x: np.pad(x, (0, dim - len(x)))
                held[key] = [grown(a) + grown(sums), grown(n) + grown(counts)]
        rows = [(*key, *x) for key, x in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], [*keys, "sums", "counts"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sums array<double>", "counts array<long>"])
    return merged_sums(vectors.select(column, *keys).mapInArrow(run, schema), *keys)


def merged_sums(sums: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, sums, counts) added up: one row a key."""
    each = sums.select(*keys, F.posexplode(F.arrays_zip("sums", "counts")).alias("pos", "x"))
    placed = each.groupBy(*keys, "pos").agg(F.sum("x.sums").alias("s"), F.sum("x.counts").alias("n"))
    whole = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "s", "n"))).alias("x"))  # dim values
    return whole.select(*keys, F.transform("x", lambda x: x["s"]).alias("sums"), F.transform("x", lambda x: x["n"]).alias("counts"))


def mean_vector(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """One row: the mean of all vectors, place by place; empty without any."""
    return mean_of(vector_sums(vectors, column=column))


def mean_of(sums: DataFrame) -> DataFrame:
    """One row: the mean that statistics (sums, counts) of any number of rows tell."""
    each = sums.select(F.posexplode(F.arrays_zip("sums", "counts")).alias("pos", "x")).groupBy("pos").agg((F.sum("x.sums") / F.sum("x.counts")).alias("m"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))  # dim values


def centred(vector: Column, mean: Column, renormalise: bool = True) -> Column:
    moved = F.zip_with(vector, mean, lambda x, m: x.cast("double") - m)
    if not renormalise:
        return moved
    return F.when(norm(moved) <= TINY, F.transform(vector, lambda x: x.cast("double"))).otherwise(normalised(moved))


def _centred_rows(x: np.ndarray, mean: np.ndarray, renormalise: bool) -> np.ndarray:
    moved = x - mean
    if renormalise:
        length = np.sqrt(np.einsum("ij,ij->i", moved, moved))[:, None]
        moved /= np.maximum(length, TINY)
        tiny = length[:, 0] <= TINY
        if tiny.any():
            moved[tiny] = x[tiny]
    return moved


def _products(x: np.ndarray, mean: np.ndarray, side: np.ndarray, renormalise: bool) -> np.ndarray:
    """_centred_rows(x) @ side without a centred copy of x: one product with the queries and the mean, and squares."""
    both = x @ np.column_stack([side, mean])
    scores = both[:, :-1] - mean @ side
    if renormalise:
        squares = np.einsum("ij,ij->i", x, x)
        rest = squares - 2 * both[:, -1] + mean @ mean
        # near the mean differences of squares tell little: those few rows go the long way
        near = rest <= np.maximum(1e-3 * squares, TINY**2)
        scores /= np.sqrt(np.where(near, 1, rest))[:, None]
        if near.any():
            scores[near] = _centred_rows(x[near], mean, True) @ side
    return scores


def semantic_scores(
    vectors: DataFrame, queries: DataFrame, renormalise: bool = True, best: int | None = None, chars: int = 60, mean: list[float] | None = None
) -> DataFrame:
    """vectors without their vector, and query_id and score, for every query (query_id, vector); queries are a few
    rows, checked here. Vectors of another dimension than the queries' are left out. best: each task keeps only,
    for each query, its so many best texts by their first ``chars`` characters, of which the overall best are part.
    mean: where it is known from stored statistics; else the vectors are read once more for it."""
    asked = queries.select("query_id", "vector").limit(10_001).toArrow()
    if asked.num_rows > 10_000:
        raise ValueError("at most 10,000 queries in one search")
    rest = [f for f in vectors.schema.fields if f.name != "vector"]
    schema = StructType([*rest, StructField("query_id", queries.schema["query_id"].dataType), StructField("score", DoubleType())])
    if not asked.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    flat, at = _rows(asked.column("vector").combine_chunks())
    dim = int(np.diff(at).max())
    side, asked_rows = _matrix(asked.column("vector").combine_chunks(), dim)
    ids = asked.column("query_id").combine_chunks().take(pa.array(asked_rows))
    mean = np.asarray(mean_vector(vectors).first()["mean"] if mean is None else mean, np.float64)  # dim numbers
    mean = np.resize(mean, dim) if len(mean) >= dim else np.zeros(dim)
    shared = vectors.sparkSession.sparkContext.broadcast((_centred_rows(side, mean, renormalise).T, mean, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, mean, ids = shared.value
        kept: pa.RecordBatch | None = None
        for batch in batches:
            x, rows = _matrix(batch.column("vector"), len(mean))
            scores = _products(x, mean, side, renormalise)
            own = batch.drop_columns(["vector"]).take(pa.array(rows))
            for q in range(len(ids)):
                columns = [*own.columns, pa.repeat(ids[q], len(rows)), pa.array(scores[:, q])]
                out = pa.RecordBatch.from_arrays(columns, [*own.schema.names, "query_id", "score"])
                if best is None:
                    yield out
                else:
                    kept = _best_texts(out if kept is None else pa.Table.from_batches([kept, out]).combine_chunks().to_batches()[0], best, chars)
        if kept is not None:
            yield kept

    return vectors.mapInArrow(run, schema)


def _best_texts(rows: pa.RecordBatch, best: int, chars: int) -> pa.RecordBatch:
    """For each query the rows of the best beginnings of texts, ties with the last of them included."""
    query, score = rows.column("query_id"), rows.column("score").to_numpy()
    query = query.dictionary_encode().indices.to_numpy()
    keep = []
    for q in np.unique(query):
        own = np.flatnonzero(query == q)
        own = own[np.argsort(-score[own], kind="stable")]
        seen: dict[str, float] = {}
        for k in own:
            text = (rows.column("text")[k].as_py() or "")[:chars]
            if len(seen) >= best and score[k] < min(seen.values()) and text not in seen:
                break
            if score[k] >= seen.setdefault(text, score[k]):  # ties are told apart later, by the columns of the caller
                keep.append(k)
    return rows.take(pa.array(np.sort(np.array(keep, np.int64))))


def semantic_search(vectors: DataFrame, query_vector: list[float], model: str, limit: int = 20, mean: list[float] | None = None) -> DataFrame:
    """The best chunks of one model, one for each beginning of a text. mean: that of the model's vectors, where it is known."""
    spark = vectors.sparkSession
    query = spark.createDataFrame([(0, [float(x) for x in query_vector])], "query_id int, vector array<double>")
    scores = semantic_scores(vectors.where(F.col("model") == model), query, best=limit, mean=mean)
    best = keep_best(scores, "text", "score", "session_id", "seq", "chunk_index")
    return best.orderBy(F.col("score").desc(), "session_id", "seq", "chunk_index").limit(limit)


def semantic_search_many(vectors: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """The best chunks for each of many queries (query_id, vector) of one model, one for each beginning of a text."""
    scores = semantic_scores(vectors, queries, best=limit)
    text = F.substring("text", 1, 60)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "session_id", "seq", "chunk_index"))
    first = scores.withColumn("__r", rank("query_id", text)).where("__r = 1")
    return first.withColumn("__r", rank("query_id")).where(F.col("__r") <= limit).drop("__r")


def with_sessions(hits: DataFrame, sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """hits with session_uuid and project, of sessions that are indexed. Hits are few: they are the side to send."""
    own = sessions.select(F.col("id").alias("session_id"), "session_uuid", "project_id")
    names = projects.select(F.col("id").alias("project_id"), F.coalesce("cwd", "dir_name").alias("project"))
    return hits.join(own, "session_id").join(names, "project_id", "left").drop("project_id")


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted and of length 1, refused with a reason): right dimension, no nulls, a norm above 0."""
    n = norm(F.col("vector"))
    reason = (
        F.when(F.col("session_id").isNull() | F.col("seq").isNull() | F.col("vector").isNull(), "missing field")
        .when(F.size("vector") != F.col("dim"), "wrong dimension")
        .when(F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))), "not a number")
        .when(n <= 0, "zero vector")
    )
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason IS NULL").drop("reason").withColumn("vector", normalised(F.col("vector")))
    return good, judged.where("reason IS NOT NULL")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key (an upsert's result)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def unembedded_by_class(events: DataFrame, tables: dict[str, DataFrame], models: list[str], limit: int | None = None) -> DataFrame:
    """The work lists of several classes, each against its own table, as one."""
    lists = [unembedded(events, table, models, (name,), limit).withColumn("vector_class", F.lit(name)) for name, table in sorted(tables.items())]
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one)
    return out


def family(models: list[str]) -> list[str]:
    """The models and their siblings: names are provider/language/revision/dimension, and a text is embedded by that
    of its language."""
    out = list(models)
    for parts in (m.split("/") for m in models):
        if len(parts) == 4 and parts[1] in LANGUAGES:
            out += ["/".join((parts[0], x, *parts[2:])) for x in LANGUAGES]
    return list(dict.fromkeys(out))


def unembedded(events: DataFrame, vectors: DataFrame, models: list[str], classes: tuple[str, ...] = ("chat",), limit: int | None = None, least: int = 24) -> DataFrame:
    """Events without a vector of the models. The limit comes before the least length, on purpose."""
    done = vectors.where(F.col("model").isin(*models)).select("session_id", "seq").distinct()
    todo = events.where(vector_class(F.col("role")).isin(*classes)).join(done, ["session_id", "seq"], "left_anti")
    if limit is not None:
        todo = todo.orderBy("session_id", "seq").limit(limit)
    return todo.where(F.char_length("text") >= least)


def coverage(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model").agg(
        F.count("*").alias("vectors"), F.countDistinct("session_id", "seq").alias("events"), F.max("dim").alias("dim"), F.sum(4 * F.col("dim")).alias("bytes")
    )


def class_stats(vectors: DataFrame, models: list[str] | None = None) -> DataFrame:
    """For each class of the models: vectors, events, greatest dimension, bytes."""
    own = vectors if models is None else vectors.where(F.col("model").isin(*models))
    return own.groupBy("vector_class").agg(
        F.count("*").alias("vectors"), F.countDistinct("session_id", "seq").alias("events"), F.max("dim").alias("dim"), F.sum(4 * F.col("dim")).alias("bytes")
    )


def vector_models(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model", "dim").agg(F.count("*").alias("vectors")).orderBy(F.col("vectors").desc(), "model", "dim")


def geometries(runs: DataFrame) -> DataFrame:
    """Vectors by the window and stride of the runs that made them."""
    return runs.groupBy(F.concat_ws("/", F.col("chunk_words").cast("string"), F.col("chunk_stride").cast("string")).alias("geometry")).agg(F.sum("vectors").alias("vectors"))


def provenance(runs: DataFrame) -> DataFrame:
    """One row: the providers other than the one on the device, and how many runs did not finish."""
    return runs.agg(
        F.array_sort(F.collect_set(F.when(F.col("provider") != "apple", F.col("provider")))).alias("remote"), F.count_if(F.col("finished_at").isNull()).alias("unfinished")
    )


def embedded_sessions(*tables: DataFrame) -> DataFrame:
    """The sessions that any of the vector tables holds."""
    out = tables[0].select("session_id")
    for table in tables[1:]:
        out = out.union(table.select("session_id"))
    return out.distinct()


def total_vectors(model: str, *tables: DataFrame) -> DataFrame:
    """How many vectors of a model the tables hold together: counts of each, summed."""
    count = lambda t: t.where(F.col("model") == model).agg(F.count("*").alias("n"))
    out = count(tables[0])
    for table in tables[1:]:
        out = out.unionAll(count(table))
    return out.agg(F.sum("n").alias("vectors"))


def drop_legacy(vectors: DataFrame, events: DataFrame, models: list[str], current: list[str]) -> DataFrame:
    """vectors without the models named, refused while an event of the chat class lacks a vector of the current ones."""
    if not unembedded(events, vectors, current).isEmpty():
        raise ValueError("the current models do not cover all events yet")
    return vectors.where(~F.col("model").isin(*models))


def chat_coverage(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many chat events there are, and how many have a vector of any class."""
    pairs = vectors.select("session_id", "seq").distinct().withColumn("has", F.lit(1))
    chat = events.where(vector_class(F.col("role")) == "chat").join(pairs, ["session_id", "seq"], "left")
    return chat.agg(F.count("*").alias("events"), F.count("has").alias("embedded"))


def script_model(text: Column, provider: str = "hash", dim: int = 64) -> Column:
    """The model for a text by its dominant language."""
    return F.concat(F.lit(f"{provider}/"), dominant(text), F.lit(f"/r1/{dim}"))


def hashing_provider(texts: pd.Series, dim: int = 64) -> list[np.ndarray]:
    """The default embedder: signed hashed words and word pairs, of length 1. The same everywhere."""
    import zlib

    out = []
    for text in texts:
        v = np.zeros(dim, np.float32)
        words = (text or "").lower().split()
        for w in words + [a + " " + b for a, b in zip(words, words[1:])]:
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h & 1 << 20 else -1
        n = float(np.linalg.norm(v))
        out.append(v / n if n else v)
    return out


def build_embeddings(
    events: DataFrame,
    vectors: DataFrame,
    models: list[str],
    provider: Callable[[pd.Series], list[np.ndarray]] = hashing_provider,
    dim: int = 64,
    words: int = 100,
    stride: int = 50,
    most: int = MOST_CHUNKS,
    segmenter: Segmenter | None = lattice,
    **work,
) -> DataFrame:
    """New vectors of the work list, by the provider in Arrow batches; to be appended by class and model. Work is what
    has a vector of none of the models' family. most: chunks of an event, the first ones (0: all). Where the provider
    gives None for a text its vector is null."""
    todo = unembedded(events, vectors, family(models), **work)
    pieces = chunks(todo, words, stride, most, script_model(F.col("text"), dim=dim).alias("model"), vector_class(F.col("role")).alias("vector_class"), segmenter=segmenter)
    pieces = pieces.withColumn("chunk_index", F.col("chunk_index").cast("int"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(vector=[None if v is None else v.tolist() for v in provider(frame["text"])], dim=dim, text=frame["text"].str.slice(0, 400))

    return pieces.mapInPandas(
        run, "session_id long, seq long, model string, vector_class string, chunk_index int, text string, vector array<float>, dim int"
    )


def dump_chunks(events: DataFrame, vectors: DataFrame, models: list[str], path: str, most: int = MOST_CHUNKS, **work) -> None:
    """The work list's chunks as JSON lines for an engine elsewhere."""
    todo = unembedded(events, vectors, family(models), **work)
    chunks(todo, most=most).write.mode("overwrite").json(path)


def load_vectors(spark, path: str, model: str, vector_class_name: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, refused lines) of JSON lines that an engine elsewhere has made."""
    if not model:
        raise ValueError("a model is required")
    schema = "session_id long, seq long, chunk_index int, dim int, vector array<double>, text string, _corrupt string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good, refused = validate(rows)
    good = good.withColumn("model", F.lit(model)).withColumn("vector_class", F.lit(vector_class_name)).drop("_corrupt")
    numbered = good.withColumn("__o", F.monotonically_increasing_id())
    return keep_last(numbered, ["session_id", "seq", "chunk_index", "model"], "__o").drop("__o"), refused
