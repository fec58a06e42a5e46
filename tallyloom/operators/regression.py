"""Feature joins, splits, regressors per key, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import linear_models, trees
from tallyloom.operators.least_squares import Fit
from tallyloom.operators.stats import fit_errors
from tallyloom.storage import written

SEED = 12345


def wide_counts(df: DataFrame, on: str, area: str, value: str, areas: list[int], prefix: str = "count_") -> DataFrame:
    """One row per time with one column per area; repeated (time, area) rows are summed first.

    A time that lacks one of the areas is left out, as a chain of inner joins would do.
    """
    cells = [F.sum(F.when(F.col(area) == a, F.col(value))).alias(f"{prefix}{a}") for a in areas]
    return df.filter(F.col(area).isin(areas)).groupBy(on).agg(*cells).na.drop("any")


def feature_frame(labels: DataFrame, counts: DataFrame, weather: DataFrame, on: str = "ts") -> DataFrame:
    """Labels joined once with all area counts and with the weather of the hour (inner).

    Counts and weather hold a row per hour; Spark sees their size after the
    aggregation and broadcasts them when they are small.
    """
    return labels.join(counts, on).join(weather, on)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def in_training(keys: list[str], percent: int = 80, seed: int = SEED) -> Column:
    """A split by key hash: the same rows land in training whatever the partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(100)) < percent


FAMILIES = ("linear", "tree", "gbt")
ROUNDS = {"tree": 0, "gbt": 10}


def fit(df: DataFrame, key: str, label: str, features: list[str], family: str, row_keys: list[str]) -> DataFrame:
    """The models of one family for all keys, a row per key: ``coef`` or ``trees``.

    The linear one is the best of the twelve settings of the grid by its error on validation rows.
    """
    if family == "linear":
        return linear_models.best(linear_models.grid(df, key, label, features, row_keys), key)
    return trees.fit(df, key, label, features, ROUNDS[family])


def predict(df: DataFrame, models: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The rows of keys that have a model, with its ``prediction``."""
    kind = linear_models if "coef" in models.columns else trees
    return kind.predict(df, models, key, features)


def predictions(
    train: DataFrame, test: DataFrame, key: str, label: str, features: list[str], families: Iterable[str], row_keys: list[str]
) -> DataFrame:
    """The rows of ``test`` with ``family`` and ``prediction`` of models learned from ``train``."""
    each = []
    for family in families:
        models = fit(train, key, label, features, family, row_keys)
        each.append(predict(test, models, key, features).withColumn("family", F.lit(family)))
    return reduce(DataFrame.unionByName, each)


def compare(
    frame: DataFrame, key: str, features: list[str], families: Iterable[str], row_keys: list[str]
) -> DataFrame:
    """(key, family, n, rss, mse, rmse, mae, r2) on the held-out rows of each key.

    Each family is fitted for all keys together; the frame is written once.
    """
    data = written(frame.withColumn("_train", in_training(row_keys)), "frame")
    scored = predictions(data.filter("_train"), data.filter("NOT _train"), key, "label", features, families, row_keys)
    return fit_errors(scored, "label", "prediction", key, "family")


def linear_per_key(df: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """(key, term, coef, se, t, nobs, r2): ordinary least squares of every key in one job.

    The key's sums of products are taken by partial aggregation; only they are
    solved per key, so any number of keys needs a single pass.
    """
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(label).cast("double")]
    names = ["const", *features]
    size = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(size) for j in range(size)]
    clean = df.na.drop("any", subset=[label, *features])
    products = clean.groupBy(key).agg(F.array(*sums).alias("products"), F.count(F.lit(1)).alias("n"))
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            out = []
            for value, cell, n in zip(batch[key], batch["products"], batch["n"]):
                m = np.asarray(cell, dtype=float).reshape(size, size)
                if n <= len(names):
                    continue
                fit = Fit(m, int(n), list(range(len(names))))
                total = m[-1, -1] - m[0, -1] ** 2 / n
                for term, c, se in zip(names, fit.coef, fit.se):
                    out.append((value, term, c, se, c / se if se > 0 else float("nan"), int(n), 1 - fit.rss / total))
            yield pd.DataFrame(out, columns=[key, "term", "coef", "se", "t", "nobs", "r2"])

    return products.mapInPandas(
        run, f"{key} {kind}, term string, coef double, se double, t double, nobs bigint, r2 double"
    )
