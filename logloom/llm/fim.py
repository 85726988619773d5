"""Fill-in-the-middle: a text is cut in three, and its middle is moved behind the other two.

The units of a cut are code points. The ``tokenizers`` library's Split pre-tokenizer, whose pattern is one code
point and whose matches are isolated, gives each its own offsets, without any training: the length of the offset
array is n, and the offset at a rank is where a slice ends. Words recur, so a worker keeps the lengths of the arrays
of the words that it has met (KEPT of them, of at most LONG code points each). A text's array is that of its words,
shifted; it is never laid out whole, but read in blocks of BLOCK code points, whatever the text measures.

Everything else is Spark expressions: hashes of the id draw the cuts and the form, slices and restoring are
substrings by code point.

Null texts count as empty; empty texts, and those that hold a mark, stay as they are (form plain). A row without
an id draws as one whose id is the empty string. Repeated rows are rows of their own, an empty table gives an
empty one, and columns other than id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The pattern of one code point, line breaks included.
UNIT = r"[\s\S]"
BLOCK = 1 << 16
KEPT, LONG = 1 << 20, 64


class Offsets:
    """Offset arrays by the Split pre-tokenizer. Lengths of the arrays of short pieces are kept, ``most`` at a time;
    what is not at hand is split in one call for all pieces."""

    def __init__(self, pattern: str = UNIT, most: int = KEPT) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.splitter, self.most = pre_tokenizers.Split(Regex(pattern), "isolated"), most
        self.kept: dict[str, int] = {}

    def array(self, piece: str) -> np.ndarray:
        """Where each unit of the piece ends."""
        splits = self.splitter.pre_tokenize_str(piece)
        return np.fromiter((end for _, (_, end) in splits), np.int64, len(splits))

    def lengths(self, pieces: list[str]) -> np.ndarray:
        """How many units each piece has: the lengths of their offset arrays."""
        if len(self.kept) > self.most:
            self.kept.clear()
        fresh = list(set(pieces).difference(self.kept))
        if fresh:
            ends = self.array("".join(fresh))
            until = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh))), "right")
            own = dict(zip(fresh, np.diff(until, prepend=0).tolist()))
            long = [p for p in fresh if len(p) > LONG]
            self.kept |= own
            out = np.fromiter(map(self.kept.__getitem__, pieces), np.int64, len(pieces))
            for p in long:
                del self.kept[p]
            return out
        return np.fromiter(map(self.kept.__getitem__, pieces), np.int64, len(pieces))


def pieces_of(text: str) -> list[str]:
    """The text in order, cut after blanks."""
    words = text.split(" ")
    return [*(w + " " for w in words[:-1]), words[-1]]


def ranked(text: str, draws: tuple[int, int], offsets: Offsets, block: int = BLOCK) -> tuple[int, int, int]:
    """(n, first, second): the length of the text's offset array, and where the units before the smaller and
    the larger of draw % (n + 1) end."""
    sizes, pieces, last = [], [], np.zeros(0, np.int64)
    for a in range(0, len(text), block):
        pieces = pieces_of(text[a : a + block])
        last = np.cumsum(offsets.lengths(pieces))
        sizes.append(int(last[-1]))
    n = sum(sizes)
    found = []
    for rank in sorted(draw % (n + 1) for draw in draws):
        k = 0
        while k < len(sizes) and rank > sizes[k]:
            rank, k = rank - sizes[k], k + 1
        at = k * block
        if rank:
            own, until = pieces, last  # of a text of one block
            if len(sizes) > 1:
                own = pieces_of(text[at : at + block])
                until = np.cumsum(offsets.lengths(own))
            i = int(np.searchsorted(until, rank))
            before = int(until[i - 1]) if i else 0
            at += sum(map(len, own[:i])) + int(offsets.array(own[i])[rank - before - 1])
        found.append(at)
    return n, found[0], found[1]


_kept: list[Offsets] = []


def _ranked_batch(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    if not _kept:
        _kept.append(Offsets())
    rows = [ranked(t.as_py() or "", (a.as_py(), b.as_py()), _kept[0]) for t, a, b in zip(texts, first, second)]
    columns = np.array(rows, np.int64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "first", "second"])


def draw(seed: str, key: Column, k: int) -> Column:
    """The k-th (from 0) group of eight digits, as a number, of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): of the texts that may be cut, ``percent`` in a hundred are, of
    them ``spm_percent`` with the suffix first (spm), the others with the prefix first (psm)."""
    cuts = F.arrow_udf(_ranked_batch, "n long, first long, second long")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    drawn = docs.select(F.col(key).alias("id"), whole.alias("t")).select("id", "t", cuts("t", draw(seed, F.col("id"), 0), draw(seed, F.col("id"), 1)).alias("c"))
    marked = F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE)
    plain = (F.col("t") == "") | marked | (draw(seed, F.col("id"), 2) % 100 >= percent)
    form = F.when(plain, "plain").when(draw(seed, F.col("id"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    one = F.lit(1).cast("int")
    first, second = F.col("c.first").cast("int"), F.col("c.second").cast("int")
    head = F.substr("t", one, first)
    middle = F.substr("t", first + 1, second - first)
    tail = F.substr("t", second + 1)
    formed = drawn.withColumn("form", form)
    output = (
        F.when(F.col("form") == "plain", F.col("t"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    return formed.select(
        F.col("id").alias(key), F.col("c.n").alias("n"), "form", F.when(cut, F.col("c.first")).alias("prefix_chars"),
        F.when(cut, F.col("c.second") - F.col("c.first")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text of an output. No cut text holds a mark, so a mark's first place is its own."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    a = F.call_function("locate", second, output)
    b = F.call_function("locate", F.lit(MIDDLE), output)
    early, late, middle = F.substr(output, F.lit(4), a - 4), F.substr(output, a + 3, b - a - 3), F.substr(output, b + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(early, middle, late)).otherwise(F.concat(late, middle, early))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents, whole; digests of the output and of the text that is read back from it."""
    formed = fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
