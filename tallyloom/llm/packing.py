"""Best-fit packing of tokenized documents by exact complements.

A document becomes token ids with an end id; one longer than a sequence is cut into pieces of full
length, the first of which may be shorter. Which lengths go together is decided on the counts of
the lengths alone: at most ``capacity`` numbers, whatever the size of the corpus. For each length,
from the longest, single lengths, pairs and triples that fill its gap exactly are looked up by
their sum and used as often as the counts allow; what is left is packed by best fit. Spark then
hands each piece its place: the n-th piece of a length takes the n-th slot of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import keep, plain

CAPACITY = 2048
PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "part int, nth bigint"
)
# How byte-level vocabularies of this kind cut words.
FULL_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACED_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def encoder(path: str):
    """A function from text to little-endian 32-bit ids, equal to the ids of the vocabulary file.

    ``path`` names a byte-level vocabulary file of the tokenizers library (JSON). Its ranks are run
    by tiktoken, several times as fast. Where no two white spaces meet, which is nearly
    everywhere, words are cut by a pattern without look-ahead; both patterns cut such texts alike.
    """
    import json
    import re

    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible}
    letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    ranks = {bytes(letters[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in special}
    known = {"mergeable_ranks": ranks, "special_tokens": special}
    full = tiktoken.Encoding("full", pat_str=FULL_WORDS, **known)
    spaced = tiktoken.Encoding("spaced", pat_str=SPACED_WORDS, **known)
    meet = re.compile(r"\s\s").search

    def ids_of(text: str) -> bytes:
        own = full if meet(text) else spaced
        return own.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    return ids_of


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids."""
    head = n % capacity or capacity
    return [(0, head), *((head + i * capacity, capacity) for i in range((n - head) // capacity))]


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the part (task) that made it, and
    ``nth``, its number among the pieces of this part with the same length; with ``with_ids`` also
    ``ids`` (little-endian 32-bit).

    Null text counts as empty: one piece with the end id alone. Repeated rows are packed once each.
    Write the result (``keep``) before using ``part`` and ``nth``: they belong to one run of a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, so_far = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for name, text in zip(names, texts, strict=True):
                ids = ids_of(text.as_py() or "") + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (name, k, start, length, zlib.crc32(own), part, so_far[length])
                    rows.append((*row, own) if with_ids else row)
                    so_far[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            fields = "doc_id piece start length ids_crc32 part nth".split()
            if with_ids:
                kinds, fields = [*kinds, pa.binary()], [*fields, "ids"]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], fields)

    return plain(docs, "doc_id", "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


class Counts:
    """How many pieces of each length are left, with the lengths that still have some in order and
    the index of their pair sums, one bit for each sum."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.left)
        self.index: int | None = None

    def pairs(self, total: int) -> bool:
        """Whether two present lengths may have this sum."""
        if self.index is None:
            present = sum(1 << x for x in self.order)
            self.index = 0
            for x in self.order:
                self.index |= present << x
        return total > 0 and bool(self.index >> total & 1)

    def use(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.left[length] -= times
            if self.left[length] == 0:
                del self.left[length]
                self.order.remove(length)
                self.index = None

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(self.left.get(x, 0) // lengths.count(x) for x in set(lengths))


def exact(counts: Counts, capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Combinations that fill a sequence exactly, with how often each is used.

    A gap is looked up among the present lengths (single), among their pair sums (pair), and minus
    each present length among the pair sums again (triple); then the parts are found by the same
    index, always with the larger lengths first, which are the harder ones to place.
    """
    for longest in sorted(counts.order, reverse=True):
        while counts.left.get(longest, 0):
            found = (longest,) if longest == capacity else complement(counts, longest, capacity - longest)
            if not found:
                break
            times = counts.times(found)
            yield found, times
            counts.use(found, times)


def complement(counts: Counts, longest: int, gap: int) -> tuple[int, ...]:
    """``longest`` with one, two or three present lengths of sum ``gap``; empty if there are none."""
    left, order = counts.left, counts.order
    if gap in left and counts.times((longest, gap)):
        return (longest, gap)
    top = bisect.bisect_right(order, gap - 1)
    for a in reversed(order[:top]) if counts.pairs(gap) else ():
        if 2 * a < gap:
            break
        if gap - a in left and counts.times((longest, a, gap - a)):
            return (longest, a, gap - a)
    for a in reversed(order[:top]):
        if 3 * a < gap:
            break
        rest = gap - a
        if not counts.pairs(rest):
            continue
        for b in reversed(order[: bisect.bisect_right(order, min(a, rest - 1))]):
            if 2 * b < rest:
                break
            if rest - b in left and counts.times((longest, a, b, rest - b)):
                return (longest, a, b, rest - b)
    return ()


def best_fit(counts: Counts, capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """What is left, by best fit from the longest: each piece goes where it leaves the least gap.

    Equal sequences are handled as one with a count, so the work follows the number of different
    lengths and not the number of pieces.
    """
    open_: dict[int, list[list]] = defaultdict(list)  # by gap: [lengths, how many such sequences]
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in open_:
            bisect.insort(gaps, gap)
        open_[gap].append([lengths, times])

    for length in sorted(counts.order, reverse=True):
        n = counts.left[length]
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, n)
                put((length,) * each, n // each)
                n -= n // each * each
                continue
            gap = gaps[at]
            lengths, times = open_[gap][-1]
            each = min(gap // length, n)
            used = min(times, n // each)
            n -= used * each
            open_[gap][-1][1] -= used
            if times == used:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.remove(gap)
            put(lengths + (length,) * each, used)
    for group in open_.values():
        yield from ((lengths, times) for lengths, times in group)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how many such sequences there are."""
    left = Counts(counts)
    return [*exact(left, capacity), *best_fit(left, capacity)]


def slots(plans: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length the slots in order: length, number of the first piece, how many pieces,
    first sequence, copies of the length in each sequence, offset of the first copy."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, times in plans:
        offset = 0
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            out.append((length, used[length], times * copies, sequence, copies, offset))
            used[length] += times * copies
            offset += copies * length
        sequence += times
    return out


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``tokenize`` (as written) with ``sequence_id`` and ``offset``.

    The driver sees one count per length, at most ``capacity`` of them. The number of a piece among
    all of its length is its number in its part plus the pieces of earlier parts; a length that a
    third of all pieces share is thus numbered without bringing its pieces together.
    """
    spark = pieces.sparkSession
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = keep(parts, "packing-parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(plan(counts, capacity))
    # slots of a length by number: the last one whose first number is not above the piece's
    by_length: dict[int, list] = defaultdict(list)
    for length, first, _, sequence, copies, offset in rows:
        by_length[length].append((first, sequence, copies, offset))
    table = [(k, [list(map(int, x)) for x in v]) for k, v in by_length.items()]
    made = spark.createDataFrame(table, "length bigint, slots array<array<bigint>>")
    numbered = (
        pieces.join(parts.select("length", "part", "before"), ["length", "part"])
        .withColumn("number", F.col("before") + F.col("nth"))
        # one row per length: at most `capacity` rows, whatever the input
        .join(F.broadcast(made), "length")
    )
    return place(numbered).drop("part", "nth", "before", "number", "slots", "at")


def place(numbered: DataFrame) -> DataFrame:
    """Sequence and offset of a piece from its number and the slots of its length."""
    # halving over the ordered slots: after k steps `at` is the last slot with first number <= number
    at = F.lit(0)
    steps = numbered.withColumn("at", at)
    for step in (1 << i for i in range(12, -1, -1)):
        reached = F.col("at") + step
        steps = steps.withColumn(
            "at",
            F.when(
                (reached < F.size("slots"))
                & (F.try_element_at("slots", reached + 1)[0] <= F.col("number")),
                reached,
            ).otherwise(F.col("at")),
        )
    slot = F.element_at("slots", F.col("at") + 1)
    past = F.col("number") - slot[0]
    return steps.withColumn("sequence_id", slot[1] + F.floor(past / slot[2])).withColumn(
        "offset", slot[3] + past % slot[2] * F.col("length")
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids). Sequences have no gaps; an empty table gives no rows."""
    return assign(keep(tokenize(docs, path, capacity, end_id, with_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from ``pack(..., with_ids=True)``: sequence_id, length, ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def ids_array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
