"""Words, stop words, word runs, term weights and language labels."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, IndexToString, StopWordsRemover, StringIndexer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import LETTER_BREAK, char_grams, tokens, word_grams
from tallyloom.operators.runs import run_counts, text_counts
from tallyloom.storage import small_side, written

UNDECIDED = "un"


def default_stop_words(language: str, extra: list[str] | None = None) -> list[str]:
    """MLlib's list of one language plus the words of the domain."""
    return list(StopWordsRemover.loadDefaultStopWords(language)) + list(extra or [])


def stop_word_table(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """(language, word) rows of fixed lists."""
    rows = sorted({(lang, w.lower()) for lang, words in lists.items() for w in words})
    return spark.createDataFrame(rows, "language string, word string")


def without_stop_words(
    df: DataFrame, words: str, language: str, lists: dict[str, list[str]], out: str, default: str | None = None
) -> DataFrame:
    """Each row filtered by the list of its own language, without a shuffle.

    A row whose language has no list is filtered by the ``default`` list, or kept whole.
    """
    work, cases, empty = df, None, F.array().cast("array<string>")
    known = list(lists)
    for i, (lang, stop) in enumerate(lists.items()):
        mine = F.col(language) == lang
        if lang == default:
            mine = mine | ~F.col(language).isin(known) | F.col(language).isNull()
        work = work.withColumn(f"_in{i}", F.when(mine & F.col(words).isNotNull(), F.col(words)).otherwise(empty))
        remover = StopWordsRemover(inputCol=f"_in{i}", outputCol=f"_out{i}", stopWords=stop)
        work = remover.transform(work)
        cases = F.when(mine, F.col(f"_out{i}")) if cases is None else cases.when(mine, F.col(f"_out{i}"))
    work = work.withColumn(out, cases.otherwise(F.col(words)))
    return work.drop(*[f"_in{i}" for i in range(len(lists))], *[f"_out{i}" for i in range(len(lists))])


def prepare(
    df: DataFrame, text: str, language: str, lists: dict[str, list[str]], n: int = 1, default: str | None = None
) -> DataFrame:
    """Add tokens, stopWordFree and ngrams; all languages in one frame."""
    cut = df.withColumn("tokens", tokens(F.col(text)))
    free = without_stop_words(cut, "tokens", language, lists, "stopWordFree", default)
    return free.withColumn("ngrams", word_grams(F.col("stopWordFree"), n))


def term_counts(df: DataFrame, words: str, *keys: str, n: int = 1, min_df: int = 1) -> DataFrame:
    """Uses (tf) and documents (df) of each run of ``n`` words found in ``min_df`` documents or more."""
    return run_counts(df, words, [n], *keys, least=min_df).drop("n")


def vocabulary(df: DataFrame, terms: str, size: int = 10_000, min_df: int = 2) -> DataFrame:
    """The ``size`` most used terms that occur in at least ``min_df`` documents."""
    counted = term_counts(df, terms, min_df=min_df)
    return counted.orderBy(F.desc("tf"), F.asc("term")).limit(size)


def one_row_per_key(df: DataFrame, key: str, words: str) -> DataFrame:
    """(key, words) with the words of rows that share a key put together; only such rows are shuffled whole."""
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_again"))
    again = written(again, "repeated-keys")
    if again.isEmpty():
        return df.select(key, words)
    same = F.col(key).eqNullSafe(F.col("_again"))
    shared = df.join(again, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list(words)).alias(words))
    return df.join(again, same, "left_anti").select(key, words).unionByName(shared)


def tfidf(df: DataFrame, key: str, terms: str, size: int = 10_000, min_df: int = 2) -> DataFrame:
    """(key, term, tf, df, idf, weight) with idf = ln((m + 1) / (df + 1)).

    Words are counted inside their rows, so that only the sums of the vocabulary are shuffled; it
    never exceeds ``size`` rows, which bounds the broadcast.
    """
    m = df.agg(F.count(F.lit(1))).scalar()
    per = text_counts(one_row_per_key(df, key, terms), key, terms)
    used = per.groupBy("term").agg(F.sum("tf").alias("_uses"), F.count(F.lit(1)).alias("df"))
    vocab = used.filter(F.col("df") >= min_df).orderBy(F.desc("_uses"), F.asc("term")).limit(size)
    weighted = vocab.select("term", "df", F.log((m + 1) / (F.col("df") + 1)).alias("idf"))
    return per.join(F.broadcast(weighted), "term").withColumn("weight", F.col("tf") * F.col("idf"))


def language_hits(df: DataFrame, key: str, text: str, lists: DataFrame) -> DataFrame:
    """Stop-word hits per (key, language); words in no list count under a null language.

    Words meet the broadcast lists and are summed before anything is shuffled.
    """
    words = df.select(key, F.explode_outer(tokens(F.col(text), 1, LETTER_BREAK)).alias("word"))
    return words.join(small_side(lists), "word", "left").groupBy(key, "language").agg(F.count(F.lit(1)).alias("hits"))


def detect_language(df: DataFrame, key: str, text: str, lists: DataFrame, out: str = "detected") -> DataFrame:
    """(key, label): language with the most hits, first name on a tie, ``un`` without any hit."""
    hits = language_hits(df, key, text, lists)
    order = F.struct(F.col("language").isNull().alias("none"), (-F.col("hits")).alias("h"), F.col("language"))
    return hits.groupBy(key).agg(F.coalesce(F.min_by("language", order), F.lit(UNDECIDED)).alias(out))


def language_model(df: DataFrame, text: str, language: str, features: int = 1 << 16):
    """Naive Bayes over hashed letter runs, trained on labelled texts."""
    grams = with_grams(df, text)
    stages = [
        StringIndexer(inputCol=language, outputCol="_label", handleInvalid="skip"),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=features),
        NaiveBayes(featuresCol="_tf", labelCol="_label", predictionCol="_predicted"),
    ]
    model = Pipeline(stages=stages).fit(grams)
    names = IndexToString(inputCol="_predicted", outputCol="predicted", labels=model.stages[0].labels)
    return model, names


def with_grams(df: DataFrame, text: str, n: int = 3) -> DataFrame:
    return df.withColumn("_grams", char_grams(tokens(F.col(text), 1, LETTER_BREAK), n))


def predict_language(df: DataFrame, text: str, model, names) -> DataFrame:
    """Add the predicted label."""
    scored = names.transform(model.transform(with_grams(df, text)))
    return scored.select(*df.columns, "predicted")


def rank_terms(df: DataFrame, group: str, weight: str, k: int) -> DataFrame:
    """The k heaviest terms of each group, ties by term."""
    order = Window.partitionBy(group).orderBy(F.desc(weight), F.asc("term"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
