"""Near duplicates by b-bit MinHash, confirmed on the full shingle sets.

A document's set is hashed by PERMS functions. Runs of ROWS minima are band keys; the low BITS bits
of every minimum are packed into a signature. Documents with equal sets are one class, and only one
member of a class goes on. In a band's bucket each class is compared with the smallest class; the
share of equal low bits, corrected for chance collisions, decides whether the pair is read in full.
Buckets that still hold several components take another centre in each of a few further rounds, which
joins large groups at a cost in proportion to their rows. What is left then is compared in blocks on
the full sets, inside the tasks, so that no link between members other than the centres is lost. Joins
on keys that many rows may share (buckets, centres, components, sets) are salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Words, chunks, keep, marked, mix, plain, salted_join, shingles
from tallyloom.llm.links import components

PERMS = 160
ROWS = 4
BITS = 4
SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Standard errors by which an estimate may fall short before a pair is left unread.
SLACK = 5.5
#: Classes and shingles of a block (about, by hash); a pair of blocks is compared in one task.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Text bytes handled at a time; hashing takes some sixty times as much for a moment, in each worker.
PART = 1 << 19
#: Rounds of new centres go on while a round leaves at most this part of the rows in mixed buckets.
GAIN = 0.75
SKETCH = "doc_id bigint, set_key bigint, n bigint, signature array<bigint>, bands array<bigint>"


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def minima(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest value under each hash function."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(out, (values[at : at + 512, None] * factors).min(0), out=out)
    return out


def set_key(values: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    return int(mix(mix(values + np.uint64(7)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(values)))[0])


def sketch(docs: DataFrame, perms: int = PERMS, rows: int = ROWS) -> DataFrame:
    """doc_id, set_key, n (size of the set), signature and bands of every row; a text without words
    has n = 0 and no signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, salts = numbers(perms, 1), numbers(perms, 2)
        places = (np.arange(64 // BITS) * BITS).astype(np.uint64)
        for batch in batches:
            for part in chunks(batch, "text", PART):
                keys, sizes, signatures, bands = [], [], [], []
                for own in shingles(Words(part.column(1)), SHINGLE):
                    sizes.append(len(own))
                    if not len(own):
                        keys.append(0), signatures.append([]), bands.append([])
                        continue
                    keys.append(set_key(own))
                    low = minima(own, factors)
                    few = (mix(low) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
                    signatures.append((few << places).sum(1, dtype=np.uint64).view(np.int64))
                    bands.append(mix((low * salts).reshape(-1, rows).sum(1, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.array(keys, np.uint64).view(np.int64)),
                        pa.array(sizes, pa.int64()),
                        pa.array(signatures, pa.list_(pa.int64())),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "set_key", "n", "signature", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, SKETCH)


def likely(equal: int, perms: int = PERMS, percent: int = PERCENT) -> bool:
    """Whether ``equal`` equal low-bit values of ``perms`` allow a similarity of ``percent``."""
    chance = 1 / (1 << BITS)
    estimate = (equal / perms - chance) / (1 - chance)
    t = percent / 100
    return estimate >= t - SLACK * (t * (1 - t) / perms) ** 0.5 / (1 - chance)


def least_equal(perms: int = PERMS, percent: int = PERCENT) -> int:
    """The fewest equal values that are still read in full."""
    return next(k for k in range(perms + 1) if likely(k, perms, percent))


def equal_values(a: Column, b: Column, perms: int = PERMS) -> Column:
    """How many low-bit values of two signatures agree, by bit counts of their words."""
    total = F.lit(perms)
    for i in range(perms * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total - F.bit_count(x)
    return total


def classes_of(sketches: DataFrame) -> DataFrame:
    """One row per different set: set_key, its number of rows and, of its smallest document, doc_id, n, signature, bands."""
    one = F.min(F.struct("doc_id", "n", "signature", "bands")).alias("one")
    copies = F.count(F.lit(1)).alias("copies")
    return (
        sketches.filter("n > 0 and doc_id is not null").groupBy("set_key").agg(one, copies).select("set_key", "copies", "one.*")
    )


def star_pairs(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each class with the smallest of its bucket, and the members (band, set_key, size, least, n) of buckets of two and more."""
    buckets = keep(bands.groupBy("band").agg(F.min("set_key").alias("least"), F.count("*").alias("n")).filter("n > 1"), "minhash-buckets")
    members = keep(salted_join(bands, buckets, "band", "set_key", sizes=buckets), "minhash-members")
    pairs = members.filter("set_key != least").select(F.col("least").alias("a"), F.col("set_key").alias("b")).distinct()
    return keep(pairs, "minhash-stars"), members


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and signatures allow the similarity, with the ids of their documents."""
    one = lambda x: classes.select(
        F.col("set_key").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")
    )
    centres = pairs.groupBy("a").agg(F.count("*").alias("n"))
    others = marked(one("b"), "b", keep(pairs.select("b").distinct(), "minhash-others"))
    both = salted_join(pairs.join(others, "b"), one("a"), "a", "b", prune=True, sizes=centres)
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    return both.filter(close & (equal_values(F.col("s_a"), F.col("s_b")) >= least_equal())).select("a", "b", "doc_a", "doc_b")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets, made again from the texts, are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, list] = (0, [])  # pairs of one document tend to follow each other
        for batch in batches:
            for part in chunks(batch, "text_b", PART):
                a, b = (part.column(i).to_pylist() for i in (0, 1))
                others = shingles(Words(part.column(3)), SHINGLE)
                keep_row = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    if last[0] != a[i] or not last[1]:
                        last = (a[i], [shingles(Words(part.column(2).slice(i, 1)), SHINGLE)[0]])
                    x, y = last[1][0], others[i]
                    if wanted(x, a[i]) and wanted(y, b[i]):
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        keep_row[i] = 100 * shared >= PERCENT * (len(x) + len(y) - shared)
                    elif not wanted(x, a[i]):
                        last = (0, [])
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(keep_row)) for c in (part.column(0), part.column(1))], ["a", "b"]
                )

    def wanted(values: np.ndarray, key: int) -> bool:
        # rows that share a doc_id bring several texts; only the one of the class counts
        return len(values) > 0 and set_key(values) == key % (1 << 64)

    texts = docs.filter("doc_id is not null").select("doc_id", "text")
    one = lambda x: texts.select(F.col("doc_id").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}"))
    centres = pairs.groupBy("doc_a").agg(F.count("*").alias("n"))
    others = marked(one("b"), "doc_b", keep(pairs.select("doc_b").distinct(), "minhash-others"))
    rows = salted_join(pairs.join(others, "doc_b"), one("a"), "doc_a", "doc_b", sizes=centres, prune=True).select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(work, "a bigint, b bigint").distinct()


def full_sets(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """set_key and set (its hashes, made again from the text) of the classes named by ``keys``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", PART):
                sets = shingles(Words(part.column(1)), SHINGLE)
                # rows that share a doc_id bring several texts; only the one of the class counts
                own = [i for i, k in enumerate(part.column(0).to_pylist()) if len(sets[i]) and set_key(sets[i]) == k % (1 << 64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0)[i].as_py() for i in own], pa.int64()),
                        pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64())),
                    ],
                    ["set_key", "set"],
                )

    named = keep(classes.select("set_key", "doc_id").join(keys, "set_key"), "minhash-named")
    texts = marked(docs.filter("doc_id is not null").select("doc_id", "text"), "doc_id", named.select("doc_id").distinct())
    rows = named.join(texts, "doc_id").select("set_key", "text")
    return rows.mapInArrow(work, "set_key bigint, set array<bigint>").dropDuplicates(["set_key"])


def forest(keys: np.ndarray, labels: np.ndarray, starts: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of a group: as few as connect what similar sets connect.

    ``values[starts[i] : starts[i + 1]]`` is the set of member i. Shared shingles are counted through
    an index from shingle to members, one member against all later ones at a time; a member whose
    component holds all of them is passed over.
    """
    sizes = np.diff(starts)
    whose = np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(values, kind="stable")
    _, of, counts = np.unique(values, return_inverse=True, return_counts=True)
    listed, begin = whose[order], np.cumsum(counts) - counts
    root = np.unique(labels, return_inverse=True)[1]
    out = []
    for r in range(len(keys) - 1):
        if (root == root[r]).all():
            break
        own = of[starts[r] : starts[r + 1]]
        n = counts[own]
        place = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(listed[place], minlength=len(keys))
        linked = 100 * shared >= PERCENT * (sizes + sizes[r] - shared)
        for k in r + 1 + np.flatnonzero(linked[r + 1 :] & (root[r + 1 :] != root[r])):
            if root[k] != root[r]:
                root[root == root[k]] = root[r]
                out.append((int(keys[r]), int(keys[k])))
    return out


def mixed_rows(rows: DataFrame) -> DataFrame:
    """The rows (band, set_key, size, label) of buckets that hold several labels."""
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), (F.min("label") != F.max("label")).alias("mixed"))
    buckets = keep(buckets.filter("mixed").drop("mixed"), "minhash-mixed-buckets")
    return keep(salted_join(rows, buckets.select("band"), "band", "set_key", sizes=buckets), "minhash-mixed")


def relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the labels that follow from links between them."""
    label = lambda x: rows.select(F.col("set_key").alias(x), F.col("label").alias(f"label_{x}")).distinct()
    of = components(links.join(label("a"), "a").join(label("b"), "b"), "label_a", "label_b").withColumnRenamed("label", "above")
    joined = salted_join(rows, of.withColumnRenamed("node", "label"), "label", "set_key", "left")
    return joined.select("band", "set_key", "size", F.coalesce("above", "label").alias("label"))


def rounds(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """Links found by comparing each mixed bucket's members with another centre each round, the
    rows whose buckets are mixed after them, and their number. A round is one comparison a row."""
    found: list[DataFrame] = []
    left = rows.count()
    while left:
        order = F.xxhash64("set_key", "band", F.lit(len(found)))
        centres = rows.groupBy("band").agg(
            F.min(F.struct(order.alias("order"), F.col("set_key").alias("centre"), F.col("label").alias("own"))).alias("one"),
            F.count("*").alias("n"),
        )
        centres = keep(centres.select("band", "n", "one.centre", "one.own"), "minhash-centres")
        pairs = salted_join(rows, centres.drop("n"), "band", "set_key", sizes=centres).filter("label != own")
        pairs = pairs.select(F.col("centre").alias("a"), F.col("set_key").alias("b"))
        pairs = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-stars")
        links = keep(confirmed(keep(estimated(pairs, classes), "minhash-pairs"), docs), "minhash-links")
        if links.isEmpty():
            break
        found.append(links)
        rows = mixed_rows(relabelled(rows, links))
        before, left = left, rows.count()
        if left > GAIN * before:
            break
    return found, rows, left


def rest_links(members: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Links inside buckets of three and more classes that are in different components so far.

    Rounds of new centres come first. What they leave is cut by bucket into blocks of about BLOCK
    classes and BLOCK_SHINGLES shingles, and each pair of blocks is one group, so no group grows with
    the bucket or the length of its texts. Full sets are compared inside the task, and a group gives
    at most one link less than it has members.
    """
    # the smallest member has been compared with all others
    rows = members.filter("n > 2 and set_key != least")
    rows = rows.join(labels, rows["set_key"] == labels["node"], "left").select(
        "band", "set_key", "size", F.coalesce("label", "set_key").alias("label")
    )
    rows = mixed_rows(keep(rows, "minhash-rows"))
    found, rows, left = rounds(rows, classes, docs)
    rest = block_links(rows, classes, docs) if left else rows.select(F.col("set_key").alias("a"), F.col("set_key").alias("b"))
    return reduce(DataFrame.union, found, rest)


def block_links(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between rows (band, set_key, size, label) that share a band and differ in label, as few as
    connect what similar sets connect in each pair of blocks."""
    sets = keep(full_sets(rows.select("set_key").distinct(), classes, docs), "minhash-sets")
    count = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    buckets = keep(rows.groupBy("band").agg(count.alias("blocks"), F.count("*").alias("n")), "minhash-blocks")
    cut = salted_join(rows, buckets.drop("n"), "band", "set_key", sizes=buckets)
    own = F.pmod(F.xxhash64("set_key", F.lit(3)), F.col("blocks")).cast("int")
    spread = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = F.collect_list(F.struct("set_key", "label", "set")).alias("members")
    groups = spread.join(sets, "set_key").groupBy("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    groups = groups.agg(members, F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("members")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in range(batch.num_rows):
                one = batch.column(0).slice(row, 1).flatten()
                sets = one.field("set")
                starts = sets.offsets.to_numpy().astype(np.int64)
                values = sets.flatten().to_numpy(zero_copy_only=False)
                key, label = (one.field(x).to_numpy(zero_copy_only=False) for x in ("set_key", "label"))
                found += forest(key, label, starts - starts[0], values)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.mapInArrow(work, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    component_id is the smallest doc_id that links reach, the document's own for a text without words
    (n_shingles 0, linked with nothing). Rows with equal sets are linked, repeated rows too. A row
    without doc_id is linked with nothing, has no component and is kept. Texts are read whole.
    """
    docs = plain(docs, "doc_id", "text")
    sketches = keep(sketch(docs), "minhash-sketches")
    classes = keep(classes_of(sketches), "minhash-classes")
    bands = classes.select("set_key", F.col("n").alias("size"), F.explode("bands").alias("band"))
    stars, members = star_pairs(bands)
    links = keep(confirmed(keep(estimated(stars, classes), "minhash-pairs"), docs), "minhash-links")
    labels = components(links)
    more = keep(rest_links(members, classes, labels, docs), "minhash-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    member = classes.select("set_key", "doc_id").join(labels, F.col("set_key") == F.col("node"), "left")
    member = member.select("set_key", "doc_id", F.coalesce("label", "set_key").alias("label"))
    member = keep(member, "minhash-members")
    first = keep(member.groupBy("label").agg(F.min("doc_id").alias("component"), F.count("*").alias("n")), "minhash-components")
    found = salted_join(member, first.drop("n"), "label", "set_key", sizes=first).select("set_key", "component")
    rows = sketches.select("doc_id", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"), F.col("n").alias("n_shingles"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    copies = classes.select("set_key", F.col("copies").alias("n"))
    return salted_join(rows, found, "set_key", "doc_id", "left", sizes=copies).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )
