"""Polarity lexicons learned from texts: seed words give their polarity to the words around them.

Words that stand near each other are the edges of a graph, counted over all texts. In each round a
word takes the mean of its neighbours, weighted by how often they meet; seeds keep their polarity.
Polarities are whole millionths, so a result does not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import tokens
from tallyloom.operators.runs import pair_counts
from tallyloom.storage import written

MILLION = 1_000_000


def near_words(df: DataFrame, text: str, language: str, reach: int = 2, least: int = 3) -> DataFrame:
    """(language, word, other, n): different words at most ``reach`` places apart, ``least`` times or more.

    Pairs are numbered and added up inside the tasks before the shuffle. A null text or language has none.
    """
    known = df.filter(F.col(text).isNotNull() & F.col(language).isNotNull())
    own = known.select(F.col(language).alias("language"), tokens(F.col(text), 1).alias("_words"))
    met = pair_counts(own, "_words", "language", reach, least)
    met = written(met, "near-words")
    return met.unionByName(met.select("language", F.col("other").alias("word"), F.col("word").alias("other"), "n"))


def learned(
    graph: DataFrame, seeds: DataFrame, rounds: int = 3, support: int = 30, strength: int = 20_000
) -> DataFrame:
    """(language, word, polarity): the seeds, and words that are met ``support`` times or more and whose
    polarity after ``rounds`` rounds is ``strength`` millionths or more on either side.

    ``seeds``: (language, word, polarity), each word once. Without a graph only the seeds come out.
    """
    fixed = seeds.select("language", "word", F.round(F.col("polarity") * MILLION).cast("bigint").alias("score"))
    totals = written(graph.groupBy("language", "word").agg(F.sum("n").alias("total")), "word-totals")
    scores = fixed
    for _ in range(rounds):
        given = scores.select("language", F.col("word").alias("other"), "score")
        sums = graph.join(given, ["language", "other"]).groupBy("language", "word").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
        mean = F.call_function("div", F.col("s"), F.col("total"))
        taught = sums.join(fixed, ["language", "word"], "left_anti").join(totals, ["language", "word"])
        scores = written(taught.select("language", "word", mean.alias("score")).unionByName(fixed), "polarities")
    kept = scores.join(fixed.select("language", "word"), ["language", "word"], "left_anti").join(totals, ["language", "word"])
    kept = kept.filter((F.col("total") >= support) & (F.abs("score") >= strength)).select("language", "word", "score")
    return kept.unionByName(fixed).select("language", "word", (F.col("score") / MILLION).alias("polarity"))
