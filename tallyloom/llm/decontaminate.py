"""Benchmark items inside documents, by MinHash containment in size classes and an exact check.

Only DataFrame functions. An item's set of five-word shingles is reduced to the SKETCH shingles with
the smallest hashes, a uniform sample of the set. A document that holds a share of the item's
shingles holds about that share of the sample, however long the document is. Items are partitioned
by the size of their sets: in each class the sample, the hits a document needs and the least size of
a document follow from the class. What has the hits is a candidate, and the full sets decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import keep, plain
from tallyloom.llm.spans import bound

SHINGLE = 5
#: An item is contained if 100 * shared >= PERCENT * size of the item.
PERCENT = 75
SKETCH = 24
#: Chance that a contained item has too few hits.
MISS = 1e-7
#: Sketch rows sent to all tasks at once, at most; more items are taken in several blocks.
BLOCK_ROWS = 300_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; null text has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", -1)
    return F.filter(parts, lambda w: w != "")


def shingles(text: Column) -> Column:
    """Distinct 64-bit hashes of the word runs; fewer words than a run make one, no words none."""

    def runs(own: Column) -> Column:
        n, none = F.size(own), F.array().cast("array<bigint>")
        each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(SHINGLE)]))
        return F.when(n == 0, none).when(n < SHINGLE, F.array(F.xxhash64(F.concat_ws(" ", own)))).otherwise(F.array_distinct(each))

    return bound(words(text), runs)


def least_hits(sample: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Hits that a contained item has but for a chance of ``miss``, if each sampled shingle is shared
    with ``percent`` in a hundred (sampling without replacement is steadier than that)."""
    p, chance = percent / 100, 0.0
    for hits in range(sample + 1):
        chance += math.comb(sample, hits) * p**hits * (1 - p) ** (sample - hits)
        if chance > miss:
            return max(hits, 1)
    return 1


def items_of(benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, item (its shingles), size, part (size class), need (hits). Repeated rows count once;
    rows without an id or without words are no items.

    Part 0 has the items whose whole set is the sample: they need their share exactly. Part k has
    sizes up to SKETCH * 2**k.
    """
    rows = plain(benchmark, "item_id", "text").filter("item_id is not null").distinct()
    rows = rows.select("item_id", shingles(F.col("text")).alias("item")).withColumn("size", F.size("item")).filter("size > 0")
    part = F.when(F.col("size") <= SKETCH, 0).otherwise(F.ceil(F.log2(F.col("size") / SKETCH))).cast("int")
    whole = F.ceil(F.col("size") * percent / 100)
    need = F.when(F.col("size") <= SKETCH, whole).otherwise(F.lit(least_hits(SKETCH, percent)))
    return rows.withColumn("part", part).withColumn("need", need.cast("int"))


def candidates(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, tag and item_id of pairs with enough hits.

    ``docs`` has doc_id, tag and text. The sketches are sent to the documents, in blocks of at most
    about BLOCK_ROWS rows, so what is sent has a bound and every item meets every document.
    """
    least = F.when(F.col("part") == 0, F.ceil(F.col("size") * percent / 100)).otherwise(
        F.ceil(F.pow(F.lit(2), F.col("part") - 1) * SKETCH * percent / 100)
    )
    sketch = items.select("item_id", "need", least.alias("least"), F.explode(F.slice(F.array_sort("item"), 1, SKETCH)).alias("h"))
    sketch = keep(sketch, "leaks-sketch")
    blocks = max(1, math.ceil(sketch.count() / BLOCK_ROWS))
    sized = bound(shingles(F.col("text")), lambda own: F.transform(own, lambda h: F.struct(h.alias("h"), F.size(own).alias("n"))))
    rows = docs.select("doc_id", "tag", F.explode(sized).alias("x")).select("doc_id", "tag", "x.h", "x.n")
    found = None
    for block in range(blocks):
        sent = F.broadcast(sketch.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
        hits = rows.join(sent, "h").filter("n >= least").groupBy("doc_id", "tag", "item_id").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
        own = hits.filter("hits >= need").select("doc_id", "tag", "item_id")
        found = own if found is None else found.union(own)
    return keep(found, "leaks-candidates")


def contained(docs: DataFrame, items: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, tag, item_id, shared, size of the candidates that hold their share of the item's full
    set. Each text is read once more where it is a candidate."""
    pairs = pairs.join(items.select("item_id", "item", "size"), "item_id")
    pairs = pairs.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("item_id", "item", "size")).alias("items"))
    both = docs.alias("d").join(pairs.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.tag = p.tag")).select("d.doc_id", "d.tag", "d.text", "p.items")
    told = lambda own: F.transform(
        F.col("items"),
        lambda x: F.struct(x["item_id"].alias("item_id"), F.size(F.array_intersect(own, x["item"])).alias("shared"), x["size"].alias("size")),
    )
    one = both.select("doc_id", "tag", F.explode(bound(shingles(F.col("text")), told)).alias("x")).select("doc_id", "tag", "x.*")
    return one.filter(F.col("shared") * 100 >= F.col("size") * percent).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, tag (hash of the text), item_id, shared and size of each contained item."""
    docs = plain(docs, "doc_id", "text").withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = keep(items_of(benchmark, percent), "leaks-items")
    return contained(docs, items, candidates(docs, items, percent), percent)


def per_document(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, by commas) and containment (the highest
    share of an item, 0 without one) of every row. Null and empty texts hold nothing."""
    found = leaks(docs, benchmark, percent).groupBy("doc_id", "tag").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("item_id")).cast("array<string>")).alias("item_ids"),
        F.countDistinct("item_id").alias("n_items"),
        F.max(F.col("shared") / F.col("size")).alias("containment"),
    )
    rows = plain(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    joined = rows.alias("r").join(found.alias("f"), F.expr("r.doc_id <=> f.doc_id and r.tag = f.tag"), "left")
    return joined.select(
        "r.doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept."""
    found = leaks(docs, benchmark, percent).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    found = keep(found, "leaks-found")
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (tag == F.col("_tag")), "left_anti")
