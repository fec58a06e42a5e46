"""Linear regressions of all keys in one pass, from sums of products.

A key's rows are reduced to the sums of all products of features and label, by partial aggregation.
Every setting of the elastic net, its error on validation rows and the fit on all rows follow from
these sums, so the number of settings costs no further pass and no key is fitted by a job of its own.

The penalty acts on features divided by their deviation and a label divided by its own, as in
Spark's linear regression; the intercept bears none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.series_models import f_upper

#: Penalty, with or without intercept, share of the absolute penalty.
GRID = list(itertools.product([0.1, 0.01], [False, True], [0.0, 0.5, 1.0]))
SWEEPS, STEPS, CLOSE = 100_000, 1000, 1e-13


def products(df: DataFrame, key: str, label: str, features: list[str], *more: str) -> DataFrame:
    """(key, more, n, products): the upper triangle of the summed products of 1, features and label."""
    cells = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(label).cast("double")]
    sums = [F.sum(a * b) for a, b in itertools.combinations_with_replacement(cells, 2)]
    clean = df.na.drop("any", subset=[key, label, *features])
    return clean.groupBy(key, *more).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("products"))


def square(cells: Iterable[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.fromiter(cells, float)
    return out + np.triu(out, 1).T


def signed_start(full: np.ndarray, b: np.ndarray, flat: float) -> np.ndarray:
    """The minimum of x'full x / 2 - b'x + flat |x|, by solving for ever better sets of signs.

    Each step either brings in the term that pulls most or goes along the line to the solution for the present
    signs as far as the error falls, so the number of steps does not depend on how alike the terms are, as that of
    sweeps over single terms does. A singular matrix may end it early; the sweeps go on from what it gives.
    """
    x, sign = np.zeros(len(b)), np.zeros(len(b))

    def error(v: np.ndarray) -> float:
        return v @ full @ v / 2 - b @ v + flat * np.abs(v).sum()

    for _ in range(STEPS):
        pull = b - full @ x
        out = np.where(sign == 0, np.abs(pull) - flat, -1.0)
        settled = np.all(np.abs(pull - flat * sign)[sign != 0] <= CLOSE * (1 + np.abs(full) @ np.abs(x))[sign != 0])
        if settled:
            if not len(b) or out.max() <= CLOSE * (1 + np.abs(b).max()):
                break
            sign[np.argmax(out)] = np.sign(pull[np.argmax(out)])
        on = np.flatnonzero(sign)
        goal = np.zeros(len(b))
        goal[on] = np.linalg.lstsq(full[np.ix_(on, on)], b[on] - flat * sign[on], rcond=None)[0]
        # the places on the way where a term changes its sign, and the goal itself
        with np.errstate(divide="ignore", invalid="ignore"):
            part = x / (x - goal)
        stops = []
        for i in np.flatnonzero((x != 0) & (part > 0) & (part < 1)):
            stop = x + part[i] * (goal - x)
            stop[i] = 0.0
            stops.append(stop)
        new = min([goal, *stops], key=error)
        if not error(new) < error(x):
            break
        x, sign = new, np.sign(new)
    return x


def elastic_net(m: np.ndarray, reg: float, intercept: bool, mix: float) -> np.ndarray:
    """Intercept and coefficients that minimise the penalised error whose sums of products are ``m``."""
    n = m[0, 0]
    mean, both = m[0, 1:] / n, m[1:, 1:] / n
    spread = np.sqrt(np.maximum(np.diag(both) - mean**2, 0))
    out = np.zeros(len(m) - 1)
    if spread[-1] == 0:
        if intercept or mean[-1] == 0:
            out[0] = mean[-1]
            return out
        spread[-1] = abs(mean[-1])
    used = np.flatnonzero(spread[:-1] > 0)
    if intercept:
        both = both - np.outer(mean, mean)
    scaled = both / np.outer(np.where(spread > 0, spread, 1), np.where(spread > 0, spread, 1))
    a, b = scaled[np.ix_(used, used)], scaled[used, -1]
    flat, ridge = reg * mix / spread[-1], reg * (1 - mix) / spread[-1]
    full = a + ridge * np.eye(len(used))
    if flat == 0:
        x = np.linalg.lstsq(full, b, rcond=None)[0]
    else:
        x = signed_start(full, b, flat)
        for _ in range(SWEEPS):
            most = 0.0
            for i in range(len(used)):
                pull = b[i] - full[i] @ x + full[i, i] * x[i]
                new = np.sign(pull) * max(abs(pull) - flat, 0) / full[i, i]
                most, x[i] = max(most, abs(new - x[i])), new
            if most < CLOSE:
                break
    out[1 + used] = x * spread[-1] / spread[used]
    if intercept:
        out[0] = mean[-1] - out[1:] @ mean[:-1]
    return out


def squared_error(m: np.ndarray, coef: np.ndarray) -> float:
    """The sum of squared residuals of ``coef`` on the rows summed in ``m``."""
    v = np.append(-coef, 1.0)
    return max(float(v @ m @ v), 0.0)


def grid(
    df: DataFrame, key: str, label: str, features: list[str], row_keys: list[str], settings: list[tuple] = GRID,
    percent: int = 80, seed: int = 54321,
) -> DataFrame:
    """(key, reg_param, intercept, elastic_net, rmse, coef): every setting for every key.

    ``rmse`` is the error on about 100 - ``percent`` of the rows, told by the hash of ``row_keys``,
    of the fit on the others; ``coef`` holds intercept and coefficients fitted on all rows. A key
    without rows on one of the sides has an rmse of null.
    """
    from tallyloom.operators.regression import in_training

    kind, size = dict(df.dtypes)[key], len(features) + 2
    sums = products(df.withColumn("_part", in_training(row_keys, percent, seed)), key, label, features, "_part")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {bool(p): square(c, size) for p, c in zip(pdf["_part"], pdf["products"], strict=True)}
        out = []
        for reg, own, mix in settings:
            rmse = None
            if len(parts) == 2:
                held = parts[False]
                rmse = float(np.sqrt(squared_error(held, elastic_net(parts[True], reg, own, mix)) / held[0, 0]))
            coef = elastic_net(sum(parts.values()), reg, own, mix)
            out.append((pdf[key].iloc[0], reg, own, mix, rmse, coef.tolist()))
        return pd.DataFrame(out, columns=[key, "reg_param", "intercept", "elastic_net", "rmse", "coef"])

    shape = f"{key} {kind}, reg_param double, intercept boolean, elastic_net double, rmse double, coef array<double>"
    return sums.groupBy(key).applyInPandas(run, shape)


def best(settings: DataFrame, key: str) -> DataFrame:
    """(key, coef): the setting of least validation error, of equal ones the stronger penalty."""
    order = F.struct(F.coalesce("rmse", F.lit(float("inf"))), -F.col("reg_param"), -F.col("elastic_net"), ~F.col("intercept"))
    return settings.groupBy(key).agg(F.min_by("coef", order).alias("coef"))


def predict(df: DataFrame, models: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The rows of keys that have a model, with ``prediction``."""
    value: Column = F.col("coef")[0]
    for i, f in enumerate(features):
        value = value + F.col("coef")[i + 1] * F.col(f)
    return df.join(models, key).withColumn("prediction", value).drop("coef")


def summary(df: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """(key, term, coef, se, t, p_value) of the unpenalised fit; keys with fewer rows than terms are left out."""
    kind, size = dict(df.dtypes)[key], len(features) + 2
    names = ["intercept", *features]

    def run(batches):
        for batch in batches:
            out = []
            for name, cells in zip(batch[key], batch["products"], strict=True):
                m = square(cells, size)
                dof = m[0, 0] - len(names)
                if dof <= 0:
                    continue
                coef = plain_fit(m)
                spread = np.linalg.pinv(m[:-1, :-1]).diagonal() * squared_error(m, coef) / dof
                se = np.sqrt(np.maximum(spread, 0))
                for term, c, s in zip(names, coef, se, strict=True):
                    t = c / s if s > 0 else float("nan")
                    out.append((name, term, c, s, t, f_upper(t * t, 1, int(dof)) if s > 0 else float("nan")))
            yield pd.DataFrame(out, columns=[key, "term", "coef", "se", "t", "p_value"])

    shape = f"{key} {kind}, term string, coef double, se double, t double, p_value double"
    return products(df, key, label, features).mapInPandas(run, shape)


def plain_fit(m: np.ndarray) -> np.ndarray:
    """Least squares on columns scaled to equal length, so that units do not matter."""
    scale = np.sqrt(np.maximum(np.diag(m)[:-1], 1e-300))
    return np.linalg.lstsq(m[:-1, :-1] / np.outer(scale, scale), m[:-1, -1] / scale, rcond=None)[0] / scale


def plain(df: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """(key, coef) of the unpenalised fits."""
    kind, size = dict(df.dtypes)[key], len(features) + 2

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "coef": [plain_fit(square(c, size)).tolist() for c in batch["products"]]})

    return products(df, key, label, features).mapInPandas(run, f"{key} {kind}, coef array<double>")


def training(df: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """(key, metric, value) of the unpenalised fits on their own rows."""
    y, p = F.col(label), F.col("prediction")
    clean = df.na.drop("any", subset=[key, label, *features])
    fitted = predict(clean, plain(df, key, label, features), key, features)
    # explained variance is taken about the mean label, which the second aggregate needs
    sums = fitted.groupBy(key).agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("_var"),
        (F.avg(p * p) - 2 * F.avg(p) * F.avg(y) + F.avg(y) * F.avg(y)).alias("explained_variance"),
    )
    named = {"r2": 1 - F.col("mse") / F.col("_var"), "rmse": F.sqrt("mse"), **{c: F.col(c) for c in ("explained_variance", "mse", "mae")}}
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in named.items()])
    return sums.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
