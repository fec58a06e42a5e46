"""Helpers shared by the training-data operators: written tables, and words of whole Arrow batches as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyloom.storage import scratch_path

#: Text bytes handled at a time inside a task; a longer document is handled alone.
CHUNK = 1 << 21
#: Parts of a table beyond which a join key is salted.
SHARE = 1000
#: Bits for each key of a filter, and the longs that a filter has at most (8 MB).
FILTER_BITS, FILTER_LONGS = 16, 1 << 20
#: Up to so many keys are broadcast themselves instead of a filter.
FEW_KEYS = 1 << 14
#: Fixed odd numbers of the polynomial and mixing hashes.
BASE = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
SPACE = frozenset([0x20, *range(0x09, 0x0E)])


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends here: a lost executor makes Spark read the table again, and what was decided
    once (counters, samples) is the same for every later reader.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(one: DataFrame, key: str, keys: DataFrame, many: int | None = None) -> DataFrame:
    """The rows of ``one`` whose ``key`` is among the distinct keys of the table ``keys``, and few others.

    The keys set two bits each of a Bloom filter, which is broadcast, so that wide rows that a join will not
    need are not shuffled for it. The filter holds at most FILTER_LONGS longs: beyond some four million keys
    more other rows pass, but none is lost. Up to FEW_KEYS keys are broadcast themselves. ``many`` spares
    the count of the keys where it is known.
    """
    from pyspark.sql import functions as F

    if many is None:
        many = keys.count()
    if many <= FEW_KEYS:
        return one.join(F.broadcast(keys.select(key)), key, "left_semi").select(*one.columns)
    longs = 1
    while longs < min(many * FILTER_BITS // 64, FILTER_LONGS):
        longs *= 2
    places = [F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(64 * longs)) for seed in (1, 2)]
    at = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*places)).alias("_at"))
    bits = at.select(F.shiftright("_at", 6).alias("id"), F.expr("shiftleft(1L, int(_at & 63))").alias("bits"))
    # a zero for each place, so that no long is missing
    every = bits.union(keys.sparkSession.range(longs).select("id", F.lit(0).cast("bigint"))).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    whole = keep(every.agg(F.array_sort(F.collect_list(F.struct("id", "bits")))["bits"].alias("_filter")), "key-filter")
    is_set = [F.getbit(F.col("_filter")[F.shiftright(p, 6).cast("int")], p.bitwiseAND(63).cast("int")) == 1 for p in places]
    return one.join(F.broadcast(whole), is_set[0] & is_set[1], "left_semi")


def salted_join(
    many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", sizes: DataFrame | None = None, share: int = SHARE, prune: bool = False
) -> DataFrame:
    """``many.join(one, key, how)`` (inner or left) where a key may hold any part of the rows of ``many``.

    A key with more than one ``share``-th of all rows is dealt by the hash of column ``by`` over as many
    salts as it has such shares, and its rows of ``one`` are copied for each salt. There are fewer
    than ``share`` such keys and at most twice as many salts, whatever the data, so their list is
    broadcast. Without such keys nothing is salted but null keys. ``sizes`` (key, n) spares the count of the
    keys where it is known. With ``prune`` nearly all rows of ``one`` whose key is not in ``many`` go before
    the shuffle (``marked``), which pays where few of many wide rows are needed.
    """
    from pyspark.sql import functions as F

    if sizes is None:
        sizes = many.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(key, "n")
    if prune:
        sizes = keep(sizes, "key-sizes")
    total, most, keys = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    if prune:
        one = marked(one, key, sizes, keys)
    left, right, count = many, one, F.lit(1)
    if most > 1 and most * share > total:
        salts = F.ceil(F.col("n") * share / F.lit(total)).cast("int")
        hot = keep(sizes.filter(F.col("n") * share > total).filter("n > 1").select(key, salts.alias("_salts")), "hot-keys")
        left, right = (x.join(F.broadcast(hot), key, "left") for x in (many, one))
        count = F.coalesce(F.col("_salts"), F.lit(1))
    elif how == "inner":
        return many.join(one, key)
    # a null key meets nothing, so its rows may lie anywhere
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.when(F.col(key).isNull(), share).otherwise(count)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")


def plain(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Columns the table lacks are null; other columns are dropped,
    so names that clash with an operator's own columns do no harm."""
    from pyspark.sql import functions as F

    kinds = {"doc_id": "bigint", "page_id": "bigint", "item_id": "bigint"}
    return docs.select(
        *[
            (F.col(f"`{n}`") if n in docs.columns else F.lit(None)).cast(kinds.get(n, "string")).alias(n)
            for n in names
        ]
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        line = np.full(n + 1, base, np.uint64)
        line[0] = 1
        out.append(np.cumprod(line, dtype=np.uint64))
    return out[0], out[1]


def spans_of_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row borders in them; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    if data is None or not n or borders[-1] == borders[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]]
    return raw, borders - borders[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most ``limit`` text bytes, or one longer row."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of the rows of a string column.

    ``start``, ``end``: byte places in ``raw``; ``row``: the row of each word; ``first``: place of
    the first word of each row (one more entry at the end); ``hash``: 64 bits of the word, letters
    A-Z lower-cased. ``separators``: the bytes between words.
    """

    def __init__(self, column: pa.Array, separators: frozenset[int] = SPACE, lower: bool = True):
        self.raw, self.borders = raw, borders = spans_of_bytes(column)
        rows = len(borders) - 1
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        if len(raw):
            word = inside[raw]
            full = borders[:-1][borders[:-1] < borders[1:]]
            last = borders[1:][borders[:-1] < borders[1:]] - 1
            opens, closes = word.copy(), word.copy()
            opens[1:] &= ~word[:-1]
            opens[full] = word[full]
            closes[:-1] &= ~word[1:]
            closes[last] = word[last]
            self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, borders)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        codes = np.arange(256, dtype=np.uint64)
        if lower:
            codes[65:91] = codes[97:123]
        up, down = powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mix(codes + np.uint64(1))[raw] * up[: len(raw)], out=sums[1:])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + size)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words that stay in a row, and the place of their first word."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(n - k + 1, k, np.uint64)
        weight = 1
        for i in range(k):
            weight = weight * BASE % (1 << 64)
            total += self.hash[i : n - k + 1 + i] * np.uint64(weight)
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return mix(total[at]), at


def shingles(words: Words, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word runs of length ``k``; a row with fewer
    words has its whole sequence as one, a row without words none."""
    grams, at = words.grams(k)
    cut = np.searchsorted(at, words.first)
    counts = np.diff(words.first)
    out = [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hash[words.first[row] : words.first[row + 1]]
        total = np.uint64(len(own))
        weight = 1
        for h in own:
            weight = weight * BASE % (1 << 64)
            total = np.uint64((int(total) + int(h) * weight) % (1 << 64))
        out[row] = mix(np.array([total], np.uint64))
    return out
