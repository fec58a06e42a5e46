"""Quality rules with thresholds that follow each language and source.

Each text gives whole-number measures. Their spread per language and source is kept in a mergeable
quantile sketch: counts of values in buckets whose width is about a sixteenth of the value, so that
sketches add up by adding counts. A group's thresholds are its upper quartile plus a multiple of its
quartile distance, or of a bucket's width where the quartiles meet; a group with few texts takes the
sketch of its language, or else that of all. No fixed threshold has a say. A single event (one line seen
again, one window found twice) is no evidence in a short text, so it is taken off before comparing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Words, chunks, keep, plain

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Rules: name, part and whole of the measure (in thousandths), and the size of a single event of the part.
MEASURES = (
    ("symbols", "n_symbols", "word_chars", 1),
    ("dup_lines", "n_dup_lines", "n_lines", 1),
    ("repeats", "n_repeat_words", "n_words", 2 * WINDOW),
    ("stutter", "n_stutter", "n_words", 1),
    ("capitals", "n_capitals", "word_chars", 1),
)
#: Quartile distances above the upper quartile that are still accepted.
FENCE = 8
#: Texts a group needs for a sketch of its own.
LEAST_GROUP = 200
SCHEMA = (
    "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, n_stutter bigint, n_capitals bigint, n_lines bigint"
)


def line_counts(text: bytes, space: bytes = b" \t\n\v\f\r") -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(space)]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(grams: np.ndarray, n: int, window: int = WINDOW) -> int:
    """Words of a text of ``n`` words that lie in a window found twice or more."""
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(docs: DataFrame) -> DataFrame:
    """The counts of every row (see SCHEMA); a null text has no words and no lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, begins = np.zeros(256, np.int64), np.ones(256, bool)
        symbol[list(SYMBOLS)] = 1
        begins[0x80:0xC0] = False  # bytes that continue a character
        capital = np.zeros(256, np.int64)
        capital[0x41:0x5B] = 1
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column(3), lower=False)
                raw, cut = words.raw, words.borders
                symbols = np.concatenate([[0], np.cumsum(symbol[raw])])
                points = np.concatenate([[0], np.cumsum(begins[raw])])
                own = points[words.end] - points[words.start]
                sums = np.concatenate([[0], np.cumsum(own)])
                grams, at = words.grams(WINDOW)
                where = np.searchsorted(at, words.first)
                n = np.diff(words.first)
                repeats = [repeated_words(grams[a:b], k) for a, b, k in zip(where[:-1], where[1:], n, strict=True)]
                lines = [line_counts(raw[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                counts = [n, sums[words.first[1:]] - sums[words.first[:-1]], symbols[cut[1:]] - symbols[cut[:-1]]]
                again = np.zeros(len(words.hash) + 1, np.int64)  # words equal to the word before
                again[2:] = np.cumsum((words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1]))[: len(again) - 2]
                capitals = np.concatenate([[0], np.cumsum(capital[raw])])
                counts += [np.array([x[1] for x in lines]), np.array(repeats)]
                counts += [again[words.first[1:]] - again[words.first[:-1]], capitals[cut[1:]] - capitals[cut[:-1]]]
                counts.append(np.array([x[0] for x in lines]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)), *(pa.array(np.asarray(c, np.int64)) for c in counts)],
                    "doc_id lang source n_words word_chars n_symbols n_dup_lines n_repeat_words n_stutter n_capitals n_lines".split(),
                )

    return plain(docs, "doc_id", "lang", "source", "text").mapInArrow(work, SCHEMA)


def share(part: str, whole: str, less: int = 0) -> Column:
    """Thousandths of the whole, the part without ``less``; 0 where the whole is 0."""
    left = F.greatest(F.col(part) - less, F.lit(0))
    return F.when(F.col(whole) > 0, F.floor(left * 1000 / F.col(whole))).otherwise(F.lit(0)).cast("bigint")


def width(value: Column) -> Column:
    """The width of a value's bucket."""
    return F.when(value < 32, F.lit(1)).otherwise(F.pow(F.lit(2), F.floor(F.log2(value + F.lit(0.5))) - 4)).cast("bigint")


def bucket(value: Column) -> Column:
    """Whole numbers below 32 have a bucket each, larger ones one for each sixteenth of a power of two."""
    return (F.floor(value / width(value)) * width(value)).cast("bigint")


def sketch(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the buckets (named by their least value) of every measure by ``keys``."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(share(a, b)).alias("bucket")) for m, a, b, _ in MEASURES]))
    return (
        measures.select(*keys, values.alias("v")).groupBy(*keys, "v.measure", "v.bucket").agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure the number of texts and the highest value that is accepted."""
    group = Window.partitionBy(*keys, "measure")
    run = sketches.withColumn("total", F.sum("n").over(group)).withColumn("sum", F.sum("n").over(group.orderBy("bucket")))
    quartile = lambda q: F.min(F.when(F.col("sum") * 4 >= F.col("total") * q, F.col("bucket")))
    cut = run.groupBy(*keys, "measure").agg(F.max("total").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    limit = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), width(F.col("q3")))
    return cut.select(*keys, "measure", "n", limit.alias("limit"))


def limits(measures: DataFrame) -> DataFrame:
    """One row per language and source with the accepted maximum of each measure.

    The table of sketches is small: buckets times measures times groups. The coarser sketches are
    made from it and not from the texts.
    """
    fine = sketch(measures, ["lang", "source"])
    own = thresholds(fine, ["lang", "source"])
    lang = thresholds(merged(fine, ["lang"]), ["lang"]).select("lang", "measure", F.col("n").alias("n_lang"), F.col("limit").alias("limit_lang"))
    all_ = thresholds(merged(fine, []), []).select("measure", F.col("limit").alias("limit_all"))
    joined = own.alias("o").join(lang.alias("l"), F.expr("o.lang <=> l.lang and o.measure = l.measure")).join(all_.alias("a"), F.expr("o.measure = a.measure"))
    chosen = F.when(F.col("o.n") >= LEAST_GROUP, F.col("o.limit")).when(F.col("n_lang") >= LEAST_GROUP, F.col("limit_lang")).otherwise(F.col("limit_all"))
    rows = joined.select("o.lang", "o.source", F.col("o.measure").alias("measure"), chosen.alias("chosen"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("chosen"))).alias(f"max_{m}") for m, *_ in MEASURES])


def judge(docs: DataFrame) -> DataFrame:
    """Every row with its counts, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows. kept: not so, and
    no measure, less a single event, above the accepted maximum of the row's language and source (nulls
    are a group too).
    """
    rows = keep(measure(docs), "quality-counts")
    top = limits(rows)
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    within = F.lit(True)
    for m, a, b, event in MEASURES:
        within = within & (share(a, b, event) <= F.col(f"max_{m}"))
    joined = rows.alias("r").join(top.alias("t"), F.expr("r.lang <=> t.lang and r.source <=> t.source"), "left")
    counts = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    return joined.select(
        *[f"r.{c}" for c in counts], base.alias("base_failed"), (~base & F.coalesce(within, F.lit(True))).alias("kept"),
        "r.lang", "r.source", "r.n_lines", *[f"max_{m}" for m, *_ in MEASURES],
    )
