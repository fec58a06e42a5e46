"""Grouped least squares on lagged values.

Rows carry their recent history as an array. Each task turns its rows into
cross-product sums per series; the sums of a series meet in one small group and
are solved there, after a first round of adding up in parts of the series. Sums are kept per history length (up to the longest lag), so
every regression can use exactly the rows that have all its lags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import halo

BLOCK = 2048
#: Sums (series and history length) that a task holds before it hands them on.
HELD = 1024
#: Parts in which the sums of a series are added up first.
PARTS = 64

Design = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def with_history(df: DataFrame, key: str, columns: list[str], max_lag: int, pos: str = "pos") -> DataFrame:
    """Add ``_h_<column>``: the values at lags 0 .. max_lag, newest first, null before the start."""
    near = halo.spread(df, pos, before=max_lag)
    w = halo.window([key], pos)
    cells = {
        f"_h_{c}": F.array(F.col(c), *[F.lag(c, k).over(w) for k in range(1, max_lag + 1)]) for c in columns
    }
    return halo.home(near.withColumns(cells))


def cross_products(
    df: DataFrame, key: str, columns: list[str], max_lag: int, design: Design, pos: str = "pos", skip: int = 0
) -> DataFrame:
    """(key, depth, n, products): summed outer products of the design rows.

    ``design`` maps positions and histories to the regressors with the target in
    the last column. A NaN regressor counts as 0: a row of depth d only enters
    regressions whose longest lag is at most d. ``skip`` leaves out the first rows.

    A task adds up all its rows, so what it hands on does not grow with the length of a series.
    """
    kind = dict(df.dtypes)[key]
    cells = {c: [f"_h_{c}_{k}" for k in range(max_lag + 1)] for c in columns}

    def table(held: dict) -> pd.DataFrame:
        return pd.DataFrame(
            {
                key: [name for name, _ in held],
                "depth": np.array([depth for _, depth in held], np.int32),
                "n": np.array([n for n, _ in held.values()], np.int64),
                "products": [m.ravel() for _, m in held.values()],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        for batch in batches:
            batch = batch[batch[pos] >= skip]
            if not len(batch):
                continue
            places = batch[pos].to_numpy()
            hist = {c: batch[names].to_numpy(dtype=float) for c, names in cells.items()}
            rows = np.nan_to_num(design(places, hist))
            depth = np.minimum(places, max_lag + skip)
            codes, names = pd.factorize(batch[key])
            spot = codes.astype(np.int64) * (max_lag + skip + 1) + depth
            order = np.argsort(spot, kind="stable")
            for start in range(0, len(order), BLOCK):
                part = order[start : start + BLOCK]
                s = spot[part]
                heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                x = rows[part]
                sums = np.add.reduceat(x[:, :, None] * x[:, None, :], heads, axis=0)
                sizes = np.diff(np.r_[heads, len(s)])
                for place, n, m in zip(s[heads], sizes, sums):
                    name = (names[place // (max_lag + skip + 1)], int(place % (max_lag + skip + 1)))
                    before = held.get(name, (0, 0.0))
                    held[name] = (before[0] + int(n), before[1] + m)
                if len(held) > HELD:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    lags = [F.get(f"_h_{c}", F.lit(k)).cast("double").alias(name) for c, all_ in cells.items() for k, name in enumerate(all_)]
    lean = df.select(key, pos, *lags)
    return added_up(lean.mapInPandas(run, f"{key} {kind}, depth int, n bigint, products array<double>"), key)


def added_up(products: DataFrame, key: str) -> DataFrame:
    """The sums of each series added up in PARTS parts, so that the last group of a series stays
    small however many tasks it came from."""
    schema = products.schema

    def add(group: pd.DataFrame) -> pd.DataFrame:
        depths, at = np.unique(group["depth"].to_numpy(), return_inverse=True)
        rows = np.stack(group["products"].to_list())
        sums, n = np.zeros((len(depths), rows.shape[1])), np.zeros(len(depths), np.int64)
        np.add.at(sums, at, rows)
        np.add.at(n, at, group["n"].to_numpy())
        return pd.DataFrame({key: [group[key].iloc[0]] * len(depths), "depth": depths, "n": n, "products": list(sums)})

    parted = products.withColumn("_part", F.spark_partition_id() % PARTS)
    return parted.groupBy(key, "_part").applyInPandas(add, schema)


class Sums:
    """Cross products of one series, by history length."""

    def __init__(self, group: pd.DataFrame):
        size = int(round(len(group["products"].iloc[0]) ** 0.5))
        products = np.stack(group["products"].to_list()).reshape(-1, size, size)
        top = int(group["depth"].max()) + 1
        self.by_depth = np.zeros((top, size, size))
        self.rows = np.zeros(top, dtype=np.int64)
        np.add.at(self.by_depth, group["depth"].to_numpy(), products)
        np.add.at(self.rows, group["depth"].to_numpy(), group["n"].to_numpy())

    def from_depth(self, depth: int) -> tuple[np.ndarray, int]:
        """Products and row count of rows with at least ``depth`` predecessors."""
        return self.by_depth[depth:].sum(axis=0), int(self.rows[depth:].sum())


class Fit:
    """Least squares of the target on some of the design columns."""

    def __init__(self, products: np.ndarray, n: int, columns: list[int], target: int = -1):
        target = target % len(products)
        xx = products[np.ix_(columns, columns)]
        xy = products[columns, target]
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        inverse = np.linalg.pinv(xx / np.outer(scale, scale), hermitian=True, rcond=1e-13) / np.outer(scale, scale)
        self.coef = inverse @ xy
        self.n = n
        self.rss = max(float(products[target, target] - self.coef @ xy), 0.0)
        self.df = n - len(columns)
        noise = self.rss / self.df if self.df > 0 else float("nan")
        self.se = np.sqrt(np.maximum(np.diag(inverse), 0) * noise)

    def aic(self) -> float:
        n = self.n
        if n == 0 or self.rss <= 0:
            return float("inf")
        return n * (np.log(2 * np.pi * self.rss / n) + 1) + 2 * len(self.coef)


def per_series(products: DataFrame, key: str, solve: Callable[[Sums], list[dict]], schema: str) -> DataFrame:
    """Solve each series from its summed products: a few small rows per series, never its data."""
    kind = dict(products.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = solve(Sums(group))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        out.insert(0, key, [group[key].iloc[0]] * len(out))
        return out

    return products.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")
