"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 0.75 or more.

Prefix filtering under several global token orders. Texts with equal sets are one class. Under any
order of all shingles, two sets that are similar enough share one of the first n - ceil(0.75 n) + 1 of
each (the prefix). The first order puts shingles that many classes hold last, so common passages seldom
are in a prefix; it gives the candidates. What sizes, places and bitmaps allow of them is intersected
with the other orders' filters: only pairs that share a prefix shingle under every order have their
sets read and their exact overlap counted.

A shingle's holders are never paired with each other wholesale. Each holder is compared with the two
of its group for which the fewest rarer shingles come before this one: an original stands there, for
its edited copies have rare shingles of their own first. What links is one component, and only holders
outside of their group's main component are compared further, with two more of its members and then
with whatever sizes, places and bitmaps allow. So no link between components is lost, a large group of
near copies costs a few comparisons a member, and groups that merely share text are told apart by
bitmaps. Shingles with many holders are salted in every join.

Shingles and sets are known by 64-bit hashes. Null and empty texts have empty sets and link with
nothing; very long texts are shingled whole. Repeated rows are one class, each with a row of the result;
rows without an id may hold a component together but name none (one of such rows alone has the id null).
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, gathered, gram_hashes, mix64, only_in, pieces, read, settle, unused
from .graph import components
from .learn import words_of

SHINGLE = 5
PERCENT = 75
ORDERS = 3
#: Shingles whose number of holders is known everywhere, at most; only the order depends on it.
HEAVY = 1 << 17
#: Holders of one salted part of a shingle, about.
PART = 4096
#: Rows of a list of pairs that is broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Longs of a class's bitmap; of the finer one, places a shingle and longs at most.
SKETCH = 32
PLACES = 32
FINE = 1 << 14
#: A salt is the number of a shingle's parts times this, and the part.
_PARTS = 1 << 16
#: All salts of a shingle, from any one of them.
_SALTS = f"IF(salt = 0, array(0), transform(sequence(1, salt div {_PARTS}), p -> int(salt div {_PARTS} * {_PARTS} + p)))"
#: Turns in which those outside of a group's main component are compared with two members of it.
HUB_TURNS = 1
#: Bits of a shingle that candidates are grouped by; what shares them by chance is told apart later.
_SHORT = np.uint64((1 << 48) - 1)
#: Holders among which each is tested against each other's size and place.
FEW = 64
#: Shingles counted together in one pass of a task.
_COUNTED = 1 << 21


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    _, _, h, first, _, _ = words_of(texts)
    grams = gram_hashes(h, SHINGLE)
    out = []
    for k in range(len(first) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    total = np.array([s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
    return int(mix64(mix64(total[:1]) + total[1:] + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0


def sketch(s: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """A bitmap of the set: 64 * longs places by hash."""
    at = mix64(s + np.uint64(0x3C6EF372FE94F82A)) % np.uint64(64 * longs)
    out = np.zeros(8 * longs, np.uint8)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out.view(np.int64)


def plausible(na: str, nb: str, sa: str, sb: str) -> Column:
    """Whether the sets of two bitmaps can overlap enough: places of one that the other lacks are shingles of one alone."""
    alone = "aggregate(zip_with({0}, {1}, (x, y) -> bit_count(x & ~y)), 0, (s, x) -> s + x)"
    most = F.least(F.col(na) - F.expr(alone.format(sa, sb)), F.col(nb) - F.expr(alone.format(sb, sa)))
    return (100 + PERCENT) * most >= PERCENT * (F.col(na) + F.col(nb))


def fine_longs(n: int) -> int:
    """Longs of the finer bitmap of a set: a power of two."""
    return min(FINE, max(SKETCH, 1 << ((n * PLACES - 1) // 64).bit_length()))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def order_keys(s: np.ndarray, order: int, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Numbers that sort shingles in a global order: by how widespread they are, then by hash."""
    key = mix64(s + np.uint64(order * 0x2545F4914F6CDD1D & (1 << 64) - 1)) >> np.uint64(6)
    tokens, level = heavy
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        key |= np.where(tokens[at] == s, level[at], 0).astype(np.uint64) << np.uint64(58)
    return key


def prefix(s: np.ndarray, order: int, heavy: tuple[np.ndarray, np.ndarray], ranked: bool = False) -> np.ndarray:
    """The first shingles of a set in a global order; ranked: in that order."""
    n, keys = prefix_length(len(s)), order_keys(s, order, heavy)
    at = np.argpartition(keys, n - 1)[:n]
    return s[at[np.argsort(keys[at])] if ranked else at]


def enough(na: str, nb: str, ra: str, rb: str) -> Column:
    """Whether sets of na and nb shingles can overlap enough if ra and rb of them are left from a shared one on."""
    na, nb, ra, rb = (F.col(x) for x in (na, nb, ra, rb))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * F.least(ra, rb) >= PERCENT * (na + nb))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and key: a hash of the text as it is."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_pass(docs: DataFrame) -> DataFrame:
    """A row a document (doc_id, key, n, sig, and bits: the bitmap, once a task), and rows (token, holders): shingles that several classes of a block hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def counted() -> pa.RecordBatch:
            token, holders = np.unique(np.concatenate(held), return_counts=True)
            token, holders = token[holders > 1], holders[holders > 1]
            none = pa.nulls(len(token), pa.int64())
            columns = [none, none, none, none, pa.nulls(len(token), pa.list_(pa.int64())), _signed(token), pa.array(holders, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "key", "n", "sig", "bits", "token", "holders"]

        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(batch.column("text"))
                sig = [signature(s) for s in sets]
                none, bits = pa.nulls(len(sets), pa.int64()), []
                for s, g in zip(sets, sig):
                    bits.append(None if g in seen or not len(s) else sketch(s))
                    if g not in seen:
                        seen.add(g)
                        held.append(s)
                        size += len(s)
                n, own = pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.list_(pa.int64()))
                columns = [batch.column("doc_id"), batch.column("key"), n, pa.array(sig, pa.int64()), own, none, none]
                yield pa.RecordBatch.from_arrays(columns, names)
                if size > _COUNTED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return _texts(docs).mapInArrow(run, "doc_id long, key long, n long, sig long, bits array<long>, token long, holders long")


def _heavy(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, level, holders) of the most widespread shingles, HEAVY at most."""
    totals = counted.groupBy("token").agg(F.sum("holders").alias("holders"))
    sizes = totals.groupBy(F.floor(F.log2("holders")).alias("level")).agg(F.count("*").alias("n")).collect()  # 64 rows at most
    least, room = 64, HEAVY
    for row in sorted(sizes, reverse=True):
        if row["n"] > room:
            break
        least, room = row["level"], room - row["n"]
    rows = totals.where(F.col("holders") >= 2**least if least < 63 else F.lit(False)).toArrow()
    token = rows.column("token").to_numpy().view(np.uint64)
    holders = rows.column("holders").to_numpy()
    order = np.argsort(token)
    token, holders = token[order], holders[order]
    return token, np.floor(np.log2(np.maximum(holders, 1))).astype(np.int64) + 1, holders


def _holders(docs: DataFrame, shared) -> DataFrame:
    """(token, salt, sig, n, rest): the first order's prefixes, of shingles that two classes or more hold. rest:
    the shingles of the set from this one on."""
    names = ["token", "salt", "sig", "n", "rest"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_, level, holders = shared.value
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces(whole, "text"):
                out: list[tuple[np.ndarray, ...]] = []
                for s in shingle_sets(batch.column("text")):
                    g = signature(s)
                    if not len(s) or g in seen:
                        continue
                    seen.add(g)
                    own = prefix(s, 0, (token_, level), ranked=True)
                    salt = np.zeros(len(own), np.int32)
                    if len(token_):
                        at = np.minimum(np.searchsorted(token_, own), len(token_) - 1)
                        parts = np.where(token_[at] == own, np.minimum(holders[at] // PART, (1 << 15) - 1), 0)
                        salt = np.where(parts, parts * _PARTS + 1 + (g & 0x7FFFFFFF) % np.maximum(parts, 1), 0).astype(np.int32)
                    n = np.int32(len(s))
                    out.append(((own & _SHORT).view(np.int64), salt, np.full(len(own), g, np.int64), np.full(len(own), n), n - np.arange(len(own), dtype=np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, those whose shingle has another holder; of few holders only such as can overlap enough with one."""
        held: list[np.ndarray] | None = None  # the rows of the last shingle seen

        def told(c: list[np.ndarray]) -> pa.RecordBatch:
            t, s, g, n, r = c
            fresh = np.append(True, (t[1:] != t[:-1]) | (g[1:] != g[:-1]))
            t, s, g, n, r = (x[fresh] for x in (t, s, g, n, r))
            at = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            size = np.diff(np.append(at, len(t)))
            keep = np.repeat(size > FEW, size) | (s > 0)
            for a, b in zip(at[(size > 2) & (size <= FEW)], (at + size)[(size > 2) & (size <= FEW)]):
                na, ra = n[a:b].astype(np.int64), r[a:b].astype(np.int64)
                both, least = na[:, None] + na, np.minimum(ra[:, None], ra)
                ok = (100 * np.minimum(na[:, None], na) >= PERCENT * np.maximum(na[:, None], na)) & ((100 + PERCENT) * least >= PERCENT * both)
                np.fill_diagonal(ok, False)
                keep[a:b] |= ok.any(1)
            two = at[(size == 2) & (s[at] == 0)]
            na, nb, rest = n[two].astype(np.int64), n[two + 1].astype(np.int64), np.minimum(r[two], r[two + 1]).astype(np.int64)
            two = two[(100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & ((100 + PERCENT) * rest >= PERCENT * (na + nb))]
            keep[two] = keep[two + 1] = True
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (t, s, g, n, r)], names)

        for batch in batches:
            c = [batch.column(k).to_numpy() for k in names]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c)]
            if not len(c[0]):
                continue
            cut = int(np.searchsorted(c[0], c[0][-1]))
            held = [x[cut:] for x in c]
            if cut:
                yield told([x[:cut] for x in c])
        if held is not None:
            yield told(held)

    return (
        _texts(docs)
        .mapInArrow(emit, "token long, salt int, sig long, n int, rest int")
        .repartition(F.col("token"), F.col("salt"))
        .sortWithinPartitions("token", "salt", "sig")
        .mapInArrow(several, "token long, salt int, sig long, n int, rest int")
    )


def _sets(docs: DataFrame, keys: DataFrame, shared) -> DataFrame:
    """(sig, prefix_1, prefix_2, ..., tokens) of the texts named in keys (key), and of a few that share a place in
    the membership bitmap: each class once a task, its prefixes under every order but the first (32 bits of a
    shingle do for a filter) and its set."""
    names = ["sig", *(f"prefix_{o}" for o in range(1, ORDERS)), "tokens"]

    def lists(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
        at = np.append(0, np.cumsum([len(s) for s in arrays])).astype(np.int32)
        return pa.ListArray.from_arrays(at, pa.array(np.concatenate(arrays).view(np.int64).astype(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, seen = shared.value[:2], set()
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = {signature(s): s for s in shingle_sets(batch.column("text")) if len(s)}
                sets = {g: s for g, s in sets.items() if g not in seen}
                seen |= set(sets)
                if sets:
                    own = [lists([prefix(s, o, heavy) for s in sets.values()], np.int32) for o in range(1, ORDERS)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), *own, lists(list(sets.values()))], names)

    schema = ", ".join(["sig long", *(f"{n} array<int>" for n in names[1:-1]), "tokens array<long>"])
    return only_in(_texts(docs), "key", keys, run, schema)


def _fine(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(sig, n, fine) of the texts named in keys: the finer bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
                columns = [[signature(s) for s in sets], [len(s) for s in sets], [sketch(s, fine_longs(len(s))) for s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["sig", "n", "fine"])

    return only_in(_texts(docs), "key", keys, run, "sig long, n long, fine array<long>")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix shingle under every order, and of these the ones that overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                s, t = (z[k].values.to_numpy() for z in (x, y))
                common = len(s) + len(t) - len(np.union1d(s, t))
                keep[k] = 100 * common >= PERCENT * (len(s) + len(t) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        left, right = (sets.select(F.col("sig").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns)) for k in "ab")
        if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # 16 bytes a row; else the joins below shuffle all sets
            right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
            pairs = F.broadcast(pairs)
        return left.join(pairs, "a").join(right, "b")

    filters = [f"prefix_{o}" for o in range(1, ORDERS)]
    every = F.lit(True)
    for name in filters:
        every &= F.arrays_overlap(f"{name}_a", f"{name}_b")
    able = gathered(sides(pairs, *filters).where(every).select("a", "b").distinct())
    joined = sides(able, "tokens").select("a", "b", F.col("tokens_a").alias("x"), F.col("tokens_b").alias("y"))
    return joined.mapInArrow(run, "a long, b long").distinct()


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, sig) of every row of docs, and (sig, key, rep, first, label) of every class with a shingle:
    a text of it, its smallest doc_id, its first (no_id, doc_id, key) and the class that stands for its component."""
    spark = docs.sparkSession
    first = gathered(_first_pass(docs))
    shared = spark.sparkContext.broadcast(_heavy(first.where("token IS NOT NULL")))
    rows = first.where("sig IS NOT NULL").select("doc_id", "key", "n", "sig")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    classes = gathered(rows.where("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.min("doc_id").alias("rep"), least))
    held = gathered(_holders(docs, shared))
    settle(spark)
    # the bitmaps of classes that share a shingle
    sharing = _small(gathered(held.select("sig").distinct()))
    bits = first.where("bits IS NOT NULL").select("sig", "bits").join(sharing, "sig", "left_semi").dropDuplicates(["sig"])
    bits = gathered(bits.join(held.groupBy("sig").agg(F.min("n").alias("n")), "sig"))

    # each holder with the two of its group that have the fewest rarer shingles before it
    part = _hubs(held, "rest - n", "rest").agg(*_two(), F.count("*").alias("holders"), F.min("sig").alias("s"), F.max("sig").alias("t"))
    ends = part.groupBy("token").agg(F.max("salt").alias("salt"), *_two(), F.sum("holders").alias("holders"), F.min("s").alias("s"), F.max("t").alias("t")).where("s < t")
    ends = gathered(ends.select("token", F.explode(F.expr(_SALTS)).alias("salt"), "low", "high", "holders"))
    stars = _ends(held.join(ends, ["token", "salt"]), "low", "high").groupBy("sig", "hub").agg(F.count("*").alias("shared"))
    stars = gathered(_overlapping(gathered(stars), bits, "sig", "hub"))
    settle(spark)
    # of three holders all pairs are compared if the two differ
    wide = held.join(ends.where("holders > 3 OR holders = 3 AND low.sig = high.sig").select("token", "salt"), ["token", "salt"])
    wide = gathered(wide)
    links, tables = [], [held, bits, ends, stars, wide]

    def linked(pairs: DataFrame) -> None:
        """Verifies pairs; what links them joins their components."""
        nonlocal labels
        found = _linked(docs, pairs, classes, shared)
        if not found.isEmpty():
            links.append(found)
            labels = components(reduce(DataFrame.unionByName, links))

    # first with the one that shares most shingles, then with the others of another component
    labels = spark.createDataFrame([], "node long, label long")
    most = stars.groupBy("sig").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    nearest = gathered(most.select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b")).distinct())
    linked(nearest)
    pairs = stars.select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b")).distinct()
    for k in "ab":
        own = labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
        pairs = pairs.join(_small(own), k, "left").withColumn(f"l{k}", F.coalesce(f"l{k}", k))
    others = gathered(pairs.where("la <> lb").select("a", "b").join(nearest, ["a", "b"], "left_anti"))
    tables += [nearest, others]
    tried = [nearest, others]
    if not others.isEmpty():
        linked(others)

    # of groups with several components, those outside of the main one: first with members of the main one,
    # then with all others
    for turn in range(HUB_TURNS + 1):
        own = wide.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        main = (
            own.groupBy("token", "label")
            .agg(F.count("*").alias("n"), F.max("salt").alias("salt"))
            .groupBy("token")
            .agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("sides"), F.max("salt").alias("salt"))
            .where("sides > 1")
            .select("token", F.explode(F.expr(_SALTS)).alias("salt"), F.col("m.label").alias("main"))
        )
        mixed = gathered(own.join(main, ["token", "salt"]))
        tables.append(mixed)
        left = mixed.where("label <> main")
        if turn < HUB_TURNS:
            order = (f"xxhash64(sig, {turn})", f"~xxhash64(sig, {turn})") if turn else ("rest - n", "rest")
            two = _hubs(mixed.where("label = main"), *order).agg(*_two()).groupBy("token").agg(F.max("salt").alias("salt"), *_two())
            two = two.select("token", F.explode(F.expr(_SALTS)).alias("salt"), "low", "high")
            met = _ends(left.join(two, ["token", "salt"]), "low", "high").select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))
            more = _overlapping(gathered(met.distinct()), bits, "a", "b")
        else:
            left = left.join(bits.select("sig", "bits"), "sig").withColumn("salt", F.explode(F.expr(_SALTS)))
            right = mixed.join(bits.select("sig", "bits"), "sig").select(
                "token", "salt", F.col("sig").alias("q"), F.col("label").alias("lq"), F.col("n").alias("nq"), F.col("rest").alias("rq"), F.col("bits").alias("bq")
            )
            able = (F.col("label") != F.col("lq")) & enough("n", "nq", "rest", "rq") & plausible("n", "nq", "bits", "bq")
            more = left.alias("l").join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.salt") == F.col("r.salt")) & able)
            more = more.select(F.least("sig", "q").alias("a"), F.greatest("sig", "q").alias("b")).distinct()
        for table in tried:
            more = more.join(table, ["a", "b"], "left_anti")
        more = gathered(more)
        tables.append(more)
        if more.isEmpty():
            continue
        tried.append(more)
        if turn == HUB_TURNS:
            more = gathered(_finely(docs, more, classes, bits))
            tables.append(more)
        linked(more)

    named = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    named = gathered(named)
    for table in [*tables, classes]:
        discard(table)
    return rows, named


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows, classes = _components(docs)
    least = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    out = classes.select("sig", "label").join(least, "label").select("sig", "component_id")
    return rows.join(out, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest (doc_id, hash of the text), rows without an id
    last. Rows without a word all stay, and of rows equal in id and text one."""
    rows, classes = _components(docs)
    own = rows.where("n > 0").select("doc_id", "key")
    stays = classes.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", F.col("first.key").alias("key"))
    gone = _small(gathered(_without(own, stays).distinct()))
    twice = gathered(own.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    name = unused(docs, "key")
    keyed = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    kept = _without(keyed, gone, name)
    if not twice.isEmpty():
        twice = _small(twice)
        kept = _without(kept, twice, name).unionByName(_without(kept, twice, name, "left_semi").dropDuplicates(["doc_id", name]))
    return kept.drop(name)


def _without(df: DataFrame, keys: DataFrame, name: str = "key", how: str = "left_anti") -> DataFrame:
    """df without (or only with) the rows whose doc_id and key are in keys; ids may be null."""
    i, k = unused(df, "other_id"), unused(df, "other_key")
    other = keys.select(F.col("doc_id").alias(i), F.col("key").alias(k))
    return df.join(other, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(name) == F.col(k)), how)


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, shared) -> DataFrame:
    """The pairs that verify. Only the sets that they name are gathered, and they go when it is done."""
    sets = gathered(_sets(docs, _named(pairs, classes).select("key"), shared))
    settle(docs.sparkSession)
    links = gathered(_verify(pairs, sets))
    discard(sets)
    return links


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    return classes.join(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct(), "sig")


def _finely(docs: DataFrame, pairs: DataFrame, classes: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs that finer bitmaps allow too. Those of sets for which the others were fine enough pass."""
    large = pairs.join(bits.where(F.col("n") > 64 * SKETCH // PLACES).select(F.col("sig").alias("a")), "a", "left_semi")
    fine = gathered(_fine(docs, _named(large, classes).select("key")).dropDuplicates(["sig"]))
    sides = [fine.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(f"f{k}")) for k in "ab"]
    # of sizes that overlap enough one bitmap is as long as the other, twice or half as long
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x | y)"
    fit = "IF(size({0}) > size({1}), " + half + ", {0})"
    both = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
    both = both.withColumns({"sa": F.expr(fit.format("fa", "fb")), "sb": F.expr(fit.format("fb", "fa"))})
    return both.where(F.col("fa").isNull() | F.col("fb").isNull() | plausible("na", "nb", "sa", "sb")).select("a", "b")


def _two() -> tuple[Column, Column]:
    """The two of a group with the highest keys."""
    return F.max("low").alias("low"), F.max("high").alias("high")


def _hubs(held: DataFrame, low: str, high: str):
    """held grouped by token and salt, and a struct for each of the keys to choose two by."""
    ends = (F.struct(F.expr(key).alias("k"), "sig", "n", "rest").alias(name) for key, name in ((low, "low"), (high, "high")))
    return held.select("*", *ends).groupBy("token", "salt")


def _overlapping(pairs: DataFrame, bits: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose bitmaps allow the overlap."""
    left, right = (bits.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"s_{k}")) for k in (a, b))
    return left.join(_small(pairs), a).join(right, b).where(plausible(f"n_{a}", f"n_{b}", f"s_{a}", f"s_{b}")).select(*pairs.columns)


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows (8 or 16 bytes each), as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _ends(stars: DataFrame, *ends: str) -> DataFrame:
    """(sig, hub): each row's sig with the sig of the structs named, where sizes and places allow; a row a shingle."""
    hubs = F.array_distinct(F.array(*(F.struct(F.col(f"{e}.sig").alias("hub"), F.col(f"{e}.n").alias("m"), F.col(f"{e}.rest").alias("left")) for e in ends)))
    each = stars.select("sig", "n", "rest", F.explode(hubs).alias("h")).select("sig", "n", "rest", "h.*")
    return each.where((F.col("sig") != F.col("hub")) & enough("n", "m", "rest", "left")).select("sig", "hub")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))
