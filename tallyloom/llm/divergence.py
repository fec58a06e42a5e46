"""How the sources of a language differ in their use of words, and by which words.

Words are counted inside tasks, a batch at a time, and added up by Spark. The words of a source and
its language fall into few cells of (count there, count in the language): the measure is evaluated
once for each cell, cells are ranked by their cumulative number of words with equal values merged,
and only the cells within the asked ranks are expanded into words again.

All numbers are whole: shares are parts of a billion (``share``), the measure of two shares p and q
is floor((p - q)**2 / (p + q)). Sums of counts may reach 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import chunks, keep, plain, spans_of_bytes

#: Text bytes counted together before counts are handed to Spark.
BATCH = 4 << 20
#: Entries (words x sources) of one block of the comparison of sources.
BLOCK = 1 << 16
LETTER = np.ones(256, bool)
LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, letters A-Z lower-cased, and the row of each."""
    raw, borders = spans_of_bytes(column)
    inside = LETTER[raw]
    edges = borders[(borders > 0) & (borders < len(raw))]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    data = LOWER[raw[inside]]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(closes) + 1 - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.searchsorted(borders, starts, side="right") - 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each batch of rows."""
    for batch in batches:
        for part in chunks(batch, "text", BATCH):
            words, row = words_of(part.column("text"))
            coded = words.dictionary_encode()
            code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
            names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
            lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
            group = lang * max(len(names[1].dictionary), 1) + source
            cell, n = np.unique(group[row] * size + code, return_counts=True)
            once = np.unique(row * size + code)
            docs = np.bincount(np.searchsorted(cell, group[once // size] * size + once % size), minlength=len(cell))
            own = cell // size
            pick = lambda values, at: values.dictionary.take(pa.array(at)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pick(names[0], own // max(len(names[1].dictionary), 1)),
                    pick(names[1], own % max(len(names[1].dictionary), 1)),
                    pick(coded, cell % size),
                    pa.array(n.astype(np.int64)),
                    pa.array(docs.astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * terms)), divided in three steps of a
    thousand so that no product leaves 64 bits."""
    whole = total + 2 * terms
    left, out = count + 2, F.lit(0).cast("bigint")
    for _ in range(3):
        # div and % of whole numbers are exact
        out = out * 1000 + F.call_function("div", left * 1000, whole)
        left = (left * 1000) % whole
    return out + 1


def measure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """``share`` of whole arrays: counts by word and source, totals by source."""
    whole = totals + 2 * terms
    left, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def compared(words: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """The measure of all pairs of sources of a language, summed over one block of its words."""
    names = groups["source"].to_numpy(object)
    place = {s: i for i, s in enumerate(names)}
    row, terms = pd.factorize(words["term"])
    table = np.zeros((len(terms), len(names)), np.int64)
    table[row, words["source"].map(place).to_numpy(np.int64)] = words["n"]
    out = []
    if len(terms):
        p = shares(table, groups["total"].to_numpy(np.int64), int(groups["terms"].iloc[0]))
        sums = [((p - p[:, [i]]) ** 2 // (p + p[:, [i]])).sum(axis=0) for i in range(len(names))]
    else:
        sums = [np.zeros(len(names), np.int64)] * len(names)
    for i, own in enumerate(sums):
        out.append(pd.DataFrame({"source": names[i], "item": np.delete(names, i), "value": np.delete(own, i)}))
    joined = pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "value": []})
    return joined.assign(lang=groups["lang"].iloc[0] if len(groups) else "")[["lang", "source", "item", "value"]]


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its
    language (``pair``, all ranks) and the words it uses more than its language (``term``, ranks to
    ``top``).

    Words are those in at least ``least`` documents of the language. A null text, lang or source is
    read as empty; '' is a language and a source like others. Repeated rows count each time. A source
    without words takes part with counts of 0; a language with one source has no pairs; an empty table
    gives no rows; columns other than text, lang and source are ignored, whatever their names. Equal
    values are ranked by the bytes of the item.
    """
    own = plain(docs, "lang", "source", "text").na.fill("", ["lang", "source", "text"])
    found = own.mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    sums = keep(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = sums.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = keep(kept.filter(F.col("docs") >= least).drop("docs"), "terms-kept")
    words = keep(sums.drop("docs").join(kept, ["lang", "term"]), "terms-of-sources")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = words.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = keep(groups.na.fill(0, ["total", "terms", "lang_total"]), "sources")
    return ranked(pairs(words, groups), "pair").unionByName(telling(words, groups, top))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(order).alias("rank")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place)


def pairs(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language.

    A language's words are dealt to blocks of about BLOCK entries; each block compares all sources
    at once and gives one row for each pair, and the blocks are added up.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    sized = groups.withColumn("blocks", F.greatest(F.ceil(F.col("terms") * n / BLOCK), F.lit(1)))
    parts = sized.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "source", "total", "terms")
    blocks = sized.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    dealt = words.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n"
    )
    kind = "lang string, source string, item string, value bigint"
    each = dealt.groupBy("lang", "block").cogroup(parts.groupBy("lang", "block")).applyInPandas(compared, kind)
    return each.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def telling(words: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The words of each source whose share is above the language's, by the measure, to rank ``top``."""
    cell = ["lang", "source", "n", "lang_n"]
    p, q = (share(F.col(c), F.col(t), F.col("terms")) for c, t in (("n", "total"), ("lang_n", "lang_total")))
    cells = words.groupBy(*cell).agg(F.count(F.lit(1)).alias("many")).join(groups, ["lang", "source"])
    cells = cells.select(*cell, "many", p.alias("p"), q.alias("q")).filter("p > q")
    cells = cells.select(*cell, "many", measure(F.col("p"), F.col("q")).alias("value"))
    # equal values are one step of the ranking; no more than ``top`` steps can matter
    steps = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    steps = steps.withColumn("step", F.row_number().over(down)).filter(F.col("step") <= top)
    before = F.sum("many").over(down) - F.col("many")
    steps = steps.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value")
    reached = cells.join(steps, ["lang", "source", "value"]).select(*cell, "value")
    expanded = words.join(reached, cell).select("lang", "source", F.col("term").alias("item"), "value")
    return ranked(expanded, "term").filter(F.col("rank") <= top)
