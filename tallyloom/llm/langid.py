"""Language identification by words first, then by ever shorter character runs.

A word seen in training is scored by its log frequency in each language. An unseen word is scored
by its character runs: by those of the greatest length of which any is known, then shorter ones,
down to single characters. A word without a known character tells nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import BASE, chunks, keep, mix, plain, powers

#: Rows a model is learned from, at most (about; they are spread over the languages and picked by a hash of the id).
TRAIN_ROWS = 20_000
#: Most frequent words, and runs of each length, that a model keeps of each language. With the rows above
#: it bounds the model, whose size grows with the features that languages have and not with their product.
FEATURES = 200_000
LONGEST = 4
#: Added to each count, so that a feature unseen in a language is unlikely and not impossible.
SMOOTH = 0.5
#: Text bytes handled at a time; words and their hashes take some ninety times as much for a moment, in each worker.
PART = 1 << 19
#: Letters lie below this code point.
LETTERS_END = 0x32400


class Letters:
    """Words (runs of letters, lower-cased) of a list of texts, as code points in one array."""

    def __init__(self, texts: list[str], letter: np.ndarray):
        low = [t.lower() for t in texts]
        self.raw = raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        borders = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
        word = letter[np.minimum(raw, LETTERS_END)]
        edge = np.zeros(len(raw) + 1, bool)
        edge[borders] = True
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1] | edge[1:-1]
        closes[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.row = np.searchsorted(borders, self.start, side="right") - 1
        up, self.down = powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mix(raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the stretches, their length included."""
        own = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(own + (end - start).astype(np.uint64) * np.uint64(BASE))

    def runs(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character runs of length ``n`` of the numbered words, and whose they are."""
        counts = np.maximum(self.end[words] - self.start[words] - n + 1, 0)
        whose = np.repeat(np.arange(len(words)), counts)
        first = np.cumsum(counts) - counts
        start = self.start[words][whose] + np.arange(len(whose)) - first[whose]
        return self.hashes(start, start + n), whose


def letter_table() -> np.ndarray:
    """Which code points are letters; the last entry stands for all above."""
    return np.array([chr(c).isalpha() for c in range(LETTERS_END)] + [False])


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the value at each place, and the first place of each value."""
    codes, values = pd.factorize(h)
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(h))[::-1]
    return codes, first


def feature_counts(docs: DataFrame) -> DataFrame:
    """How often each word (size 0) and each character run (size 1 to LONGEST) occurs per language.

    Runs are cut from each distinct word of a language once and count as often as the word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letter_table()
        for batch in batches:
            for part in chunks(batch, "text", PART):
                found = Letters(texts_of(part, "text"), letter)
                langs = pd.factorize(np.array(part.column(1).to_pylist(), object))
                every, h = np.arange(len(found.start)), found.hashes(found.start, found.end)
                lang, times = langs[0][found.row].astype(np.uint64), np.ones(len(every), np.int64)
                words = every
                for n in range(LONGEST + 1):
                    if n:
                        h, whose = found.runs(words, n)
                    else:
                        whose = every
                    codes, first = distinct(h ^ mix(lang[whose] + np.uint64(1)))
                    sums = np.bincount(codes, times[whose], len(first)).astype(np.int64)
                    own = pd.DataFrame({"lang": lang[whose[first]].astype(np.int64), "h": h[first].view(np.int64), "n": sums})
                    if not n:
                        words, lang, times = first, lang[first], sums
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(langs[1].take(own["lang"].to_numpy()).tolist(), pa.string()),
                            pa.array(np.full(len(own), n, np.int32)),
                            pa.array(own["h"].to_numpy(np.int64)),
                            pa.array(own["n"].to_numpy(np.int64)),
                        ],
                        ["lang", "size", "h", "n"],
                    )

    rows = docs.select("text", "lang").mapInArrow(count, "lang string, size int, h bigint, n bigint")
    return rows.groupBy("size", "h", "lang").agg(F.sum("n").alias("n"))


def shares(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Rows to take of each language: all of the small ones, and equal parts of the rest for the others."""
    out = {}
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, (total - sum(out.values())) // (len(sizes) - i)))
    return out


def most_frequent(counts: DataFrame, features: int) -> DataFrame:
    """The rows of ``counts`` of about the ``features`` most frequent words and runs of each length in any
    language, with their counts in all languages.

    The lowest count that is kept comes from how often each count occurs, so no task sorts a language.
    Of the words and runs with that count, those are kept that a hash picks.
    """
    levels = counts.groupBy("size", "lang", "n").agg(F.count("*").alias("many")).toPandas()
    cuts = []
    for (size, lang), own in levels.sort_values("n", ascending=False).groupby(["size", "lang"]):
        before = own["many"].cumsum() - own["many"]
        last = int((before < features).sum()) - 1
        cuts.append((int(size), lang, int(own["n"].iloc[last]), int(own["many"].iloc[last]), int(features - before.iloc[last])))
    cut = counts.sparkSession.createDataFrame(cuts, "size int, lang string, least bigint, many bigint, room bigint")
    above = (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (F.pmod(F.xxhash64("h"), F.col("many")) < F.col("room")))
    return counts.join(F.broadcast(cut), ["size", "lang"]).select("size", "h", "lang", "n", above.alias("above"))


def learn(docs: DataFrame, max_rows: int = TRAIN_ROWS, features: int = FEATURES) -> dict:
    """The model of the rows of ``docs`` with text and lang.

    At most about ``max_rows`` rows are read (spread over the languages and picked evenly by a hash of
    doc_id), and of each language about the ``features`` most frequent words and runs of each length are
    kept, so the model and what the driver sees are bounded, and a language with many rows takes
    nothing from one with few. No labelled row gives a model without languages.
    """
    docs = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    model: dict = {"langs": langs, "tables": []}
    if not langs:
        return model
    if sum(sizes.values()) > max_rows:
        part = shares(sizes, max_rows)
        wanted = docs.sparkSession.createDataFrame([(x, sizes[x], part[x]) for x in langs], "lang string, _rows bigint, _part bigint")
        docs = docs.join(F.broadcast(wanted), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.col("_rows")) < F.col("_part")).select("doc_id", "text", "lang")
    # written once: the cuts and the tables of all lengths are taken from it
    counts = keep(feature_counts(docs), "language-counts")
    every = most_frequent(counts, features)
    numbered = docs.sparkSession.createDataFrame(list(enumerate(langs)), "own int, lang string")
    wanted = every.filter("above").select("size", "h").distinct()
    cells = every.join(wanted, ["size", "h"]).join(F.broadcast(numbered), "lang").select("size", "h", "own", "n")
    cells = keep(cells, "language-features")
    for size in range(LONGEST + 1):
        model["tables"].append(Table.of(cells.filter(F.col("size") == size).toArrow(), len(langs)))
    return model


class Table(NamedTuple):
    """Log frequencies of the features of one length, only where a language has the feature.

    ``keys``: sorted hashes; the entries of key i are those from ``first[i]`` to ``first[i + 1]``, with
    their language and by how much the log frequency is above ``absent``, that of an unseen feature.
    """

    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    above: np.ndarray
    absent: np.ndarray

    @classmethod
    def of(cls, cells: pa.Table, langs: int) -> Table:
        h = cells.column("h").to_numpy().view(np.uint64)
        lang, n = cells.column("own").to_numpy().astype(np.int32), cells.column("n").to_numpy().astype(np.float64)
        order = np.lexsort((lang, h))
        keys, first = np.unique(h[order], return_index=True)
        totals = np.bincount(lang, n, langs) + SMOOTH * len(keys)
        above = np.log((n + SMOOTH) / SMOOTH)[order].astype(np.float32)
        absent = np.log(SMOOTH / np.maximum(totals, SMOOTH))
        return cls(keys, np.append(first, len(h)), lang[order].astype(np.int16), above, absent)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in self)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the keys, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def sums(self, at: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
        """Log frequencies of the keys at the given places, added up by ``whose`` (below ``n``), per language."""
        langs = len(self.absent)
        counts = self.first[at + 1] - self.first[at]
        cell = np.arange(counts.sum()) + np.repeat(self.first[at] - np.cumsum(counts) + counts, counts)
        flat = np.bincount(np.repeat(whose, counts) * langs + self.lang[cell], self.above[cell], n * langs)
        return flat.reshape(n, langs) + np.bincount(whose, minlength=n)[:, None] * self.absent


def word_scores(found: Letters, model: dict, words: np.ndarray) -> np.ndarray:
    """Per numbered word and language the log frequency, by the word or by its longest known runs."""
    table = model["tables"][0]
    at, known = table.find(found.hashes(found.start[words], found.end[words]))
    scores = table.sums(at[known], np.flatnonzero(known), len(words))
    left = np.flatnonzero(~known)
    for n in range(LONGEST, 0, -1):
        if not len(left):
            break
        h, whose = found.runs(words[left], n)
        at, hit = model["tables"][n].find(h)
        hits = np.bincount(whose[hit], minlength=len(left))
        sums = model["tables"][n].sums(at[hit], whose[hit], len(left))
        told = hits > 0
        scores[left[told]] = sums[told] / hits[told, None]
        left = left[~told]
    return scores


def judged(texts: list[str], model: dict, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the place of its language among those of the model (one past the last for none) and
    the probability of that language (0 for none)."""
    rows = len(texts)
    best, score = np.full(rows, len(model["langs"])), np.zeros(rows)
    found = Letters(texts, letter)
    if model["langs"] and len(found.start):
        # a word that occurs often is looked up once
        codes, first = distinct(found.hashes(found.start, found.end))
        words = word_scores(found, model, first)[codes]
        n = np.bincount(found.row, minlength=rows)
        sums = np.stack([np.bincount(found.row, words[:, i], rows) for i in range(words.shape[1])], 1)
        sums = sums / np.sqrt(np.maximum(n, 1))[:, None]
        chance = np.exp(sums - sums.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        best = np.where(n > 0, chance.argmax(1), best)
        score = np.where(n > 0, chance.max(1), 0)
    return best, score


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row.

    ``lang_pred`` is ``und`` (score 0) where the text is null or has no letter, or the model has no
    language; equally likely languages give the first by name. ``score`` is the probability of the
    language with the evidence of a text weighed by the square root of its number of words.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, known = letter_table(), sent.value
        langs = np.array([*known["langs"], "und"], object)
        for batch in batches:
            for part in chunks(batch, "text", PART):
                best, score = judged(texts_of(part, "text"), known, letter)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs[best].tolist(), pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(guess, "doc_id bigint, lang_pred string, score double")


def held_out():
    """Whether a document is kept from learning: a fifth, by the checksum of its id; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def label(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from those that are not held out."""
    docs = plain(docs, "doc_id", "text", "lang")
    model = learn(docs.filter(~held_out()), max_rows)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, min_score: float = 0.0, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und`` and with at least ``min_score``.

    Only the text goes to the workers, a batch at a time; all columns of ``docs`` are kept.
    """
    model = learn(plain(docs, "doc_id", "text", "lang").filter(~held_out()), max_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def told(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter, known = letter_table(), sent.value
        langs = np.array([*known["langs"], "und"], object)
        for texts in columns:
            batch = pa.RecordBatch.from_arrays([pa.array(texts.tolist(), pa.large_string())], ["text"])
            found = [judged(texts_of(part, "text"), known, letter) for part in chunks(batch, "text", PART)]
            best = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
            score = np.concatenate([x[1] for x in found]) if found else np.zeros(0)
            yield pd.DataFrame({"lang_pred": langs[best], "score": score})

    return (
        docs.withColumn("_told", told(F.col("text")))
        .filter((F.col("_told.lang_pred") != "und") & (F.col("_told.score") >= min_score))
        .drop("_told")
    )
