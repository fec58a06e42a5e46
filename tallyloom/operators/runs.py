"""Word runs counted inside tasks, in blocks of texts, before Spark adds the counts up.

A block numbers its words, then its runs of two by (number of the first word, next word) and so on,
so that texts are only put together for the different runs of a block and not for each place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.storage import written

#: Words of a block, about; a text is never cut.
BLOCK = 1 << 21
#: Buckets of terms for each partition of the texts; the lists of a bucket are merged in one task.
BUCKETS = 32
#: Words whose runs are hashed at a time, hashes that a task adds up before they go out, and hashes that are sent to
#: the tasks to have their terms told.
PIECE, ADDED, TOLD = 1 << 18, 1 << 20, 1 << 20


def blocks(batches: Iterator[pa.RecordBatch], most: int | None = None, empty: bool = False) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows, their words end to end, and the number of words of each row, in blocks of about ``most`` words. The words
    are the last column; rows without words are left out unless ``empty``."""
    for b in batches:
        own = np.asarray(pc.fill_null(b.columns[-1].value_lengths(), 0))
        if not empty:
            b, own = b.filter(pa.array(own > 0)), own[own > 0]
        ends = np.cumsum(own)
        cuts = np.flatnonzero(np.diff(ends // (most or BLOCK), append=-1)) if len(own) else []
        lo = 0
        for hi in cuts:
            part = b.slice(lo, hi + 1 - lo)
            yield part, part.columns[-1].flatten(), own[lo : hi + 1]
            lo = hi + 1


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key and the different keys by number."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def word_hashes(distinct: pa.Array) -> np.ndarray:
    words = distinct.cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False)
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def joined_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of two runs, from those of its parts; only says in which bucket a run goes."""
    return (before * np.uint64(0x9E3779B97F4A7C15) ^ after) * np.uint64(0xC2B2AE3D27D4EB4F)


def runs(words: pa.Array, sizes: np.ndarray, most: int, groups: np.ndarray | None = None) -> Iterator[tuple]:
    """(n, terms, group and hash of each term, number of the term at each place, text of each place) for runs
    of 1 to ``most`` words. ``groups`` numbers the texts' groups; a term has a number in each."""
    cut = words.dictionary_encode(null_encoding="encode")
    code, distinct = cut.indices.to_numpy(), cut.dictionary
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.zeros(len(code), np.int64) if groups is None else groups[text].astype(np.int64)
    number, keys = numbered(begin * len(distinct) + code)
    group, last = np.divmod(keys, len(distinct))
    single = word_hashes(distinct)
    terms, hashed = distinct.take(pa.array(last)), single[last]
    places = np.arange(len(code))
    yield 1, terms, group, hashed, number, text
    for n in range(2, most + 1):
        whole = (places + n - 1 < len(code)) & (text[np.minimum(places + n - 1, len(code) - 1)] == text[places])
        places = places[whole]
        number, keys = numbered(number[whole].astype(np.int64) * len(distinct) + code[places + n - 1])
        before, last = np.divmod(keys, len(distinct))
        terms = pc.binary_join_element_wise(terms.take(pa.array(before)), distinct.take(pa.array(last)), " ")
        group, hashed = group[before], joined_hash(hashed[before], single[last])
        yield n, terms, group, hashed, number, text[places]


def grouped(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's keys, and the first row of each number."""
    numbers = np.zeros(rows, np.int64)
    for column in columns:
        cells = column.dictionary_encode(null_encoding="encode")
        found, _ = numbered(numbers * len(cells.dictionary) + cells.indices.to_numpy())
        numbers = found.astype(np.int64)
    return numbers, np.unique(numbers, return_index=True)[1]


def buckets(df: DataFrame) -> int:
    """As many buckets as keep one of them small, whatever the number of rows."""
    return BUCKETS * max(df.rdd.getNumPartitions(), 1)


def dealt(hashed: np.ndarray, group: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the terms by group and bucket, where each (group, bucket) begins, its group and its bucket."""
    slot = group * many + ((hashed >> np.uint64(16)) % np.uint64(many)).astype(np.int64)
    order = np.argsort(slot.astype(np.min_scalar_type(int(slot.max()))), kind="stable")
    first = np.flatnonzero(np.diff(slot[order], prepend=-1))
    return order, np.append(first, len(order)).astype(np.int32), slot[order][first] // many, slot[order][first] % many


def added(each: DataFrame, keys: list[str], counts: list[str], least: int) -> DataFrame:
    """Terms of equal keys added up: a bucket's lists are merged in the task that gets them. Only terms
    whose last count is ``least`` or more come out."""
    shape = StructType([*[each.schema[k] for k in keys], StructField("term", StringType()), *[StructField(c, LongType()) for c in counts]])

    def merged(own: pa.Table) -> pa.Table:
        cut = pc.list_flatten(own["term"]).combine_chunks().dictionary_encode(null_encoding="encode")
        number, terms = cut.indices.to_numpy(), cut.dictionary
        sums = [np.bincount(number, pc.list_flatten(own[c]).to_numpy(), len(terms)).astype(np.int64) for c in counts]
        kept = np.flatnonzero(sums[-1] >= least)
        firsts = own.select(keys).take(np.zeros(len(kept), np.int64))
        out = [*firsts.columns, terms.take(pa.array(kept)), *[pa.array(v[kept]) for v in sums]]
        return pa.table(out, names=[*keys, "term", *counts])

    return each.groupBy(*keys, "bucket").applyInArrow(merged, shape)


def run_counts(df: DataFrame, words: str, ns: list[int], *keys: str, documents: bool = True, least: int = 1) -> DataFrame:
    """(keys, n, term, tf, df): uses of each run of ``ns`` words, and the rows that hold it.

    Words hold no blank, or runs of several are not told apart. Without ``documents`` there is no ``df``.
    Only terms with ``least`` rows (or uses, without ``documents``) come out.
    """
    rows = df.select(F.struct(*keys).alias("k") if keys else F.struct(F.lit(0).alias("none")).alias("k"), words)
    kind, many = rows.schema["k"].dataType.simpleString(), buckets(rows)
    counts = ["tf", "df"] if documents else ["tf"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, sizes in blocks(batches):
            numbers, firsts = grouped(part.column(0).flatten(), part.num_rows)
            for n, terms, group, hashed, number, text in runs(flat, sizes, max(ns), numbers):
                if n not in ns or not len(terms):
                    continue
                found = [np.bincount(number, minlength=len(terms))]
                if documents:
                    _, pairs = numbered(number.astype(np.int64) * len(sizes) + text)
                    found.append(np.bincount(pairs // len(sizes), minlength=len(terms)))
                order, begin, own, bucket = dealt(hashed, group, many)
                out = [part.column(0).take(pa.array(firsts[own])), pa.array(np.full(len(own), n, np.int32)), pa.array(bucket)]
                out += [pa.ListArray.from_arrays(begin, v) for v in (terms.take(pa.array(order)), *[pa.array(v[order]) for v in found])]
                yield pa.RecordBatch.from_arrays(out, ["k", "n", "bucket", "term", *counts])

    shape = f"k {kind}, n int, bucket bigint, term array<string>, " + ", ".join(f"{c} array<bigint>" for c in counts)
    each = rows.mapInArrow(counted, shape).select(*[F.col(f"k.{c}").alias(c) for c in keys], "n", "bucket", "term", *counts)
    return added(each, [*keys, "n"], counts, least)


@dataclass
class Vocabulary:
    """Terms, the rows that hold each, and their hashes."""

    terms: list[str]
    df: np.ndarray
    hashed: np.ndarray

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and the place of each one's term, as tasks need them."""
        order = np.argsort(self.hashed)
        return self.hashed[order], order


def places_of(index: tuple[np.ndarray, np.ndarray], hashed: np.ndarray) -> np.ndarray:
    """The place of each hash's term, -1 without one."""
    own, order = index
    at = np.minimum(np.searchsorted(own, hashed), len(own) - 1)
    return np.where(own[at] == hashed, order[at], -1)


def long_hashes(distinct: pa.Array) -> np.ndarray:
    """64 bits of each word."""
    words = distinct.fill_null("").to_numpy(zero_copy_only=False).astype(object)
    return pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def term_hashes(terms: pa.ChunkedArray, n: int) -> np.ndarray:
    """Of runs of ``n`` words without blanks, from their text."""
    words = [terms.combine_chunks()] if n == 1 else [pc.list_element(pc.split_pattern(terms, " "), i).combine_chunks() for i in range(n)]
    hashed = long_hashes(words[0])
    for own in words[1:]:
        hashed = joined_hash(hashed, long_hashes(own))
    return hashed


def spelled(code: np.ndarray, distinct: pa.Array, places: np.ndarray, n: int) -> pa.Array:
    """The runs of ``n`` words at some places as text."""
    parts = [distinct.take(pa.array(code[places + i])) for i in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def hashed_runs(words: pa.Array, sizes: np.ndarray, ns: list[int]) -> Iterator[tuple]:
    """(n, hash of the run at each place, text of each place, place, words' numbers, words) for runs of ``ns`` words."""
    cut = words.dictionary_encode(null_encoding="encode")
    code, single = cut.indices.to_numpy(), long_hashes(cut.dictionary)
    text = np.repeat(np.arange(len(sizes)), sizes)
    each = single[code]
    hashed, places = each, np.arange(len(code))
    for n in range(1, max(ns) + 1):
        if n > 1:
            whole = (places + n - 1 < len(code)) & (text[np.minimum(places + n - 1, len(code) - 1)] == text[places])
            places = places[whole]
            hashed = joined_hash(hashed[whole], each[places + n - 1])
        if n in ns:
            yield n, hashed, text[places], places, code, cut.dictionary


def summed(hashed: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each hash once, its counts added up."""
    order = np.argsort(hashed, kind="stable")
    hashed = hashed[order]
    first = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(hashed) else np.zeros(0, int)
    return hashed[first], [np.add.reduceat(c[order], first) if len(first) else c for c in counts]


def top_runs(df: DataFrame, words: str, ns: list[int], size: int, least: int = 1) -> dict[int, Vocabulary]:
    """The ``size`` most used runs of each number of words that ``least`` rows hold, ties by term; none has no entry.

    Runs are equal if 64-bit hashes of them are. They are counted as numbers; only those with enough uses are put
    together as text. Words of runs of two and more hold no blank. Where more than ``TOLD`` runs have as many uses as the last one, runs are counted as text.
    """
    spark, rows = df.sparkSession, df.select(words)
    many = buckets(rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] = {}

        def out(n: int) -> pa.RecordBatch:
            hashed, counts = joined(held.pop(n))
            bucket = (hashed % np.uint64(many)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            begin = np.append(first, len(order)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(begin, pa.array(v[order])) for v in (hashed.view(np.int64), *counts)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n, np.int32)), pa.array(bucket[order][first]), *lists], ["n", "bucket", "hash", "tf", "df"])

        def joined(parts):
            return summed(np.concatenate([h for h, _ in parts]), [np.concatenate(c) for c in zip(*[c for _, c in parts], strict=True)])

        for _, flat, sizes in blocks(batches, PIECE):
            for n, hashed, text, *_ in hashed_runs(flat, sizes, ns):
                if not len(hashed):
                    continue
                number, keys = numbered(hashed.view(np.int64))
                _, pairs = numbered(number.astype(np.int64) * len(sizes) + text)
                counts = [np.bincount(v, minlength=len(keys)) for v in (number, pairs // len(sizes))]
                held.setdefault(n, []).append((keys.view(np.uint64), counts))
                if sum(len(h) for h, _ in held[n]) > ADDED:
                    held[n] = [joined(held[n])]
                    if len(held[n][0][0]) > ADDED // 2:
                        yield out(n)
        for n in list(held):
            yield out(n)

    def merged(own: pa.Table) -> pa.Table:
        # each bucket keeps its most used runs, and all that have as many uses as the last of them
        flat = [pc.list_flatten(own[c]).to_numpy() for c in ("hash", "tf", "df")]
        hashed, (tf, rows) = summed(flat[0].view(np.uint64), flat[1:])
        kept = np.flatnonzero(rows >= least)
        if len(kept) > size:
            kept = kept[tf[kept] >= np.partition(tf[kept], len(kept) - size)[len(kept) - size]]
        n = pa.array(np.full(len(kept), own["n"][0].as_py(), np.int32))
        return pa.table([n, pa.array(hashed[kept].view(np.int64)), pa.array(tf[kept]), pa.array(rows[kept])], names=["n", "hash", "tf", "df"])

    shape = "n int, bucket bigint, hash array<bigint>, tf array<bigint>, df array<bigint>"
    each = rows.mapInArrow(counted, shape)
    uses = written(each.groupBy("n", "bucket").applyInArrow(merged, "n int, hash bigint, tf bigint, df bigint"), "uses")
    enough = {}
    for n in sorted(set(ns)):
        top = uses.filter(F.col("n") == n).orderBy(F.desc("tf")).limit(size).agg(F.min("tf"), F.count(F.lit(1))).first()
        if top[1]:
            enough[n] = top[0] if top[1] == size else 0
    if not enough:
        return {}
    wanted = uses.filter(" OR ".join(f"(n = {n} AND tf >= {tf})" for n, tf in enough.items()))
    if wanted.count() > TOLD:
        counts = written(run_counts(rows, words, list(enough), least=least), "terms")
    else:
        sent = wanted.select("n", "hash").toArrow()
        own = {n: np.sort(sent.filter(pc.equal(sent["n"], n))["hash"].to_numpy().view(np.uint64)) for n in enough}
        known = spark.sparkContext.broadcast(own)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, flat, sizes in blocks(batches, PIECE):
                for n, hashed, _, places, code, distinct in hashed_runs(flat, sizes, list(enough)):
                    own = known.value[n]
                    kept = own[np.minimum(np.searchsorted(own, hashed), len(own) - 1)] == hashed
                    # a place for each of them
                    found, first = np.unique(hashed[kept], return_index=True)
                    places = places[kept][first]
                    if len(places):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), n, np.int32)), spelled(code, distinct, places, n), pa.array(found.view(np.int64))], ["n", "term", "hash"])

        terms = rows.mapInArrow(told, "n int, term string, hash bigint").distinct()
        counts = written(terms.join(wanted, ["n", "hash"]), "terms")
        known.destroy()
    out = {}
    for n in enough:
        top = counts.filter(F.col("n") == n).orderBy(F.desc("tf"), "term").limit(size).drop("tf", "n").toArrow()
        hashed = top["hash"].to_numpy().view(np.uint64) if "hash" in top.column_names else term_hashes(top["term"], n)
        out[n] = Vocabulary(top["term"].to_pylist(), top["df"].to_numpy(), hashed)
    return out


def text_counts(df: DataFrame, key: str, words: str) -> DataFrame:
    """(key, term, tf): uses of each word in each row, nothing shuffled."""
    rows = df.select(key, words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, sizes in blocks(batches):
            _, terms, group, _, number, _ = next(runs(flat, sizes, 1, np.arange(len(sizes))))
            uses = pa.array(np.bincount(number, minlength=len(terms)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(group)), terms, uses], [key, "term", "tf"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(counted, f"`{key}` {kind}, term string, tf bigint")


def pair_counts(df: DataFrame, words: str, key: str, reach: int, least: int = 1) -> DataFrame:
    """(key, word, other, n): different words at most ``reach`` places apart in a row, the smaller first,
    met ``least`` times or more. Words hold no blank."""
    rows = df.select(key, words)
    kind, many = rows.schema[key].dataType.simpleString(), buckets(rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, sizes in blocks(batches):
            numbers, firsts = grouped([part.column(0)], part.num_rows)
            cut = flat.dictionary_encode()
            order = pc.sort_indices(cut.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            code, distinct = rank[cut.indices.to_numpy()], cut.dictionary.take(order)
            text = np.repeat(np.arange(len(sizes)), sizes)
            found = []
            for d in range(1, reach + 1):
                a, b = code[:-d], code[d:]
                met = (text[:-d] == text[d:]) & (a != b)
                a, b, group = a[met], b[met], numbers[text[:-d][met]]
                found.append((group * len(distinct) + np.minimum(a, b)) * len(distinct) + np.maximum(a, b))
            number, keys = numbered(np.concatenate(found))
            if not len(keys):
                continue
            pair, other = np.divmod(keys, len(distinct))
            group, word = np.divmod(pair, len(distinct))
            terms = pc.binary_join_element_wise(distinct.take(pa.array(word)), distinct.take(pa.array(other)), " ")
            single = word_hashes(distinct)
            order, begin, own, bucket = dealt(joined_hash(single[word], single[other]), group, many)
            uses = pa.array(np.bincount(number, minlength=len(keys))[order])
            lists = [pa.ListArray.from_arrays(begin, v) for v in (terms.take(pa.array(order)), uses)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(firsts[own])), pa.array(bucket), *lists], [key, "bucket", "term", "n"])

    each = rows.mapInArrow(counted, f"`{key}` {kind}, bucket bigint, term array<string>, n array<bigint>")
    pair = F.split("term", " ")
    return added(each, [key], ["n"], least).select(key, pair[0].alias("word"), pair[1].alias("other"), "n")
