"""Stationarity, partial autocorrelation, AR/MA/ARMA(X), causality and walk-forward forecasts.

All models are least squares on lags. Moving-average terms use the residuals of a
long autoregression in place of the unseen shocks (two-stage estimation). The
estimates are consistent, but not those of exact maximum likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import halo
from tallyloom.operators.least_squares import Fit, Sums, cross_products, per_series, with_history
from tallyloom.operators.series import centred
from tallyloom.storage import cut_lineage, small_side

# MacKinnon's published response surface for the unit-root test with a
# constant (one variable). Critical value = b0 + b1/n + b2/n^2 + b3/n^3.
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
# MacKinnon's polynomials of the statistic, mapped to p by the normal CDF.
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
P_SWITCH, P_LOW, P_HIGH = -1.61, -18.83, 2.74


def unit_root_p(stat: float) -> float:
    if stat > P_HIGH:
        return 1.0
    if stat < P_LOW:
        return 0.0
    terms = P_SMALL if stat <= P_SWITCH else P_LARGE
    z = sum(c * stat**i for i, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def f_upper(stat: float, d1: int, d2: int) -> float:
    """Upper tail of the F distribution by quadrature of the beta integral over an angle."""
    if not (stat > 0) or d2 <= 0:
        return float("nan") if math.isnan(stat) or d2 <= 0 else 1.0
    top = math.atan2(math.sqrt(d2), math.sqrt(d1 * stat))
    nodes, weights = np.polynomial.legendre.leggauss(16)
    edges = np.linspace(0.0, top, 129)
    half = (edges[1:] - edges[:-1])[:, None] / 2
    theta = half * nodes[None, :] + (edges[1:] + edges[:-1])[:, None] / 2
    logs = (d2 - 1) * np.log(np.sin(theta)) + (d1 - 1) * np.log(np.cos(theta))
    norm = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)
    return float(min(1.0, 2 * np.sum(half * weights[None, :] * np.exp(logs + norm))))


def lag_design(places: np.ndarray, hist: dict[str, np.ndarray]) -> np.ndarray:
    """[1, y lag 1 .. L, y]."""
    y = hist["_d"]
    return np.column_stack([np.ones(len(places)), y[:, 1:], y[:, 0]])


def difference_design(places: np.ndarray, hist: dict[str, np.ndarray]) -> np.ndarray:
    """[1, y lag 1, difference lags, difference]."""
    y = hist["_d"]
    steps = y[:, :-1] - y[:, 1:]
    return np.column_stack([np.ones(len(places)), y[:, 1], steps[:, 1:], steps[:, 0]])


def pair_design(places: np.ndarray, hist: dict[str, np.ndarray]) -> np.ndarray:
    """[1, y lags, x lags, y]."""
    y, x = hist["_d"], hist["_x"]
    return np.column_stack([np.ones(len(places)), y[:, 1:], x[:, 1:], y[:, 0]])


def deviations(df: DataFrame, key: str, y: str, to: str = "_d") -> DataFrame:
    """Values minus the series mean, which keeps the cross products well scaled."""
    return centred(df, [key], y).withColumn(to, F.col(y) - F.col("_mean")).drop("_var", "_n")


def pacf(df: DataFrame, key: str, max_lag: int = 20, y: str = "y", pos: str = "pos") -> DataFrame:
    """Partial autocorrelation: last coefficient of the regression on lags 1 .. k, for each k."""
    rows = with_history(deviations(df, key, y), key, ["_d"], max_lag, pos)
    sums = cross_products(rows, key, ["_d"], max_lag, lag_design, pos)

    def solve(s: Sums) -> list[dict]:
        total = int(s.rows.sum())
        out = [{"lag": 0, "pacf": 1.0, "band": 1.96 / math.sqrt(total)}]
        for k in range(1, max_lag + 1):
            products, n = s.from_depth(k)
            if n <= k + 1:
                break
            out.append({"lag": k, "pacf": Fit(products, n, list(range(k + 1))).coef[k], "band": out[0]["band"]})
        return out

    return per_series(sums, key, solve, "lag int, pacf double, band double")


def adf(df: DataFrame, key: str, max_lag: int | None = None, y: str = "y", pos: str = "pos") -> DataFrame:
    """Unit-root test with a constant; the number of lagged differences is chosen by AIC.

    A series searches up to ceil(12 (n/100)^(1/4)) and no further than half its length;
    ``max_lag`` may bound that. Without it the longest series sets the width of the sums. All candidates are compared on the same
    rows, then the best is fitted on all rows that have its lags. The p-value is
    approximate.
    """
    if max_lag is None:
        longest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 1
        max_lag = math.ceil(12 * (longest / 100) ** 0.25)
    rows = with_history(deviations(df, key, y), key, ["_d"], max_lag + 1, pos)
    sums = cross_products(rows, key, ["_d"], max_lag + 1, difference_design, pos)

    def solve(s: Sums) -> list[dict]:
        total = int(s.rows.sum())
        top = min(max_lag, math.ceil(12 * (total / 100) ** 0.25), total // 2 - 2)
        if top < 0:
            return []
        products, n = s.from_depth(top + 1)
        best = min(range(top + 1), key=lambda p: Fit(products, n, list(range(p + 2))).aic())
        products, n = s.from_depth(best + 1)
        fit = Fit(products, n, list(range(best + 2)))
        stat = float(fit.coef[1] / fit.se[1])
        crit = {c: sum(b / n**i for i, b in enumerate(bs)) for c, bs in CRITICAL.items()}
        return [{"stat": stat, "p_value": unit_root_p(stat), "lags": best, "nobs": n, **crit}]

    return per_series(
        sums, key, solve,
        "stat double, p_value double, lags int, nobs bigint, crit_1 double, crit_5 double, crit_10 double",
    )


def granger(df: DataFrame, key: str, max_lag: int = 10, y: str = "y", x: str = "x", pos: str = "pos") -> DataFrame:
    """Does x help to predict y? F test for 1 .. max_lag lags, each on all its rows."""
    both = deviations(df, key, y).drop("_mean")
    both = deviations(both, key, x, "_x")
    rows = with_history(both, key, ["_d", "_x"], max_lag, pos)
    sums = cross_products(rows, key, ["_d", "_x"], max_lag, pair_design, pos)

    def solve(s: Sums) -> list[dict]:
        out = []
        for k in range(1, max_lag + 1):
            products, n = s.from_depth(k)
            own = list(range(k + 1))
            other = list(range(1 + max_lag, 1 + max_lag + k))
            df2 = n - 2 * k - 1
            if df2 <= 0:
                break
            small, big = Fit(products, n, own), Fit(products, n, own + other)
            f = ((small.rss - big.rss) / k) / (big.rss / df2)
            out.append({"lag": k, "f_stat": f, "p_value": f_upper(f, k, df2), "df_num": k, "df_den": df2})
        return out

    return per_series(sums, key, solve, "lag int, f_stat double, p_value double, df_num int, df_den bigint")


def term_design(p: int, q: int, exog: list[str], constant: bool):
    """[1?, y lags 1..p, shock lags 1..q, exogenous values, y]."""

    def build(places: np.ndarray, hist: dict[str, np.ndarray]) -> np.ndarray:
        cells = [np.ones((len(places), 1))] if constant else []
        cells.append(hist["_d"][:, 1 : p + 1])
        if q:
            cells.append(hist["_e"][:, 1 : q + 1])
        cells += [hist[c][:, :1] for c in exog]
        cells.append(hist["_d"][:, :1])
        return np.hstack(cells)

    return build


def term_names(p: int, q: int, exog: list[str], constant: bool) -> list[str]:
    names = ["const"] if constant else []
    return names + [f"ar{i}" for i in range(1, p + 1)] + [f"ma{i}" for i in range(1, q + 1)] + list(exog)


def coefficients(
    rows: DataFrame, key: str, p: int, q: int, exog: list[str], constant: bool, max_lag: int, pos: str, skip: int
) -> DataFrame:
    """(key, terms, coef, se, nobs, rss) of one regression per series."""
    names = term_names(p, q, exog, constant)
    columns = ["_d"] + (["_e"] if q else []) + exog
    sums = cross_products(rows, key, columns, max_lag, term_design(p, q, exog, constant), pos, skip)

    def solve(s: Sums) -> list[dict]:
        products, n = s.from_depth(skip + max(p, q))
        if n <= len(names):
            return []
        fit = Fit(products, n, list(range(len(names))))
        return [{"coef": fit.coef, "se": fit.se, "nobs": n, "rss": fit.rss}]

    return per_series(sums, key, solve, "coef array<double>, se array<double>, nobs bigint, rss double").withColumn(
        "terms", F.array(*[F.lit(n) for n in names])
    )


def linear(p: int, q: int, exog: list[str], constant: bool, coef: str = "_coef") -> Column:
    """Fitted value from the coefficient array and the history arrays."""
    cells: list[Column] = [F.lit(1.0)] if constant else []
    cells += [F.col("_h__d")[i] for i in range(1, p + 1)]
    cells += [F.col("_h__e")[i] for i in range(1, q + 1)]
    cells += [F.col(c) for c in exog]
    out: Column = F.lit(0.0)
    for i, c in enumerate(cells):
        out = out + F.col(coef)[i] * c
    return out


class ArmaResult:
    """Coefficient table and fitted rows of one model over many series."""

    def __init__(self, coef: DataFrame, fitted: DataFrame, key: str):
        self._coef, self.fitted, self._key = coef, fitted, key

    @property
    def summary(self) -> DataFrame:
        """(key, term, coef, se, t, nobs)."""
        cells = F.arrays_zip("terms", "coef", "se")
        rows = self._coef.select(self._key, "nobs", F.inline(cells))
        return rows.select(
            self._key, F.col("terms").alias("term"), "coef", "se", (F.col("coef") / F.col("se")).alias("t"), "nobs"
        )


def arma(
    df: DataFrame,
    key: str,
    p: int,
    q: int,
    exog: list[str] | None = None,
    constant: bool = True,
    long_order: int | None = None,
    y: str = "y",
    pos: str = "pos",
) -> ArmaResult:
    """AR(p), MA(q), ARMA(p, q) or, with ``exog``, ARMAX by least squares.

    With q > 0 a long autoregression of ``long_order`` lags gives the shocks
    first. ``fitted`` keeps the input columns and adds fitted and resid, null in
    the rows that lack lags. The constant refers to values in deviation from
    the series mean when q or p is present, and is shifted back in ``fitted``.
    """
    exog = list(exog or [])
    base = deviations(df, key, y) if constant else df.withColumn("_mean", F.lit(0.0)).withColumn("_d", F.col(y))
    skip = 0
    if q:
        skip = long_order or max(2 * (p + q), 4)
        rows = with_history(base, key, ["_d"], skip, pos)
        first = coefficients(rows, key, skip, 0, [], constant, skip, pos, 0).select(key, F.col("coef").alias("_coef"))
        shock = F.when(F.col(pos) >= skip, F.col("_d") - linear(skip, 0, [], constant))
        base = rows.join(small_side(cut_lineage(first)), key).withColumn("_e", shock).drop("_coef", "_h__d")
    lags = max(p, q, 1)
    hist = ["_d"] + (["_e"] if q else [])
    rows = with_history(base, key, hist, lags, pos)
    wide = rows.withColumns({f"_h_{x}": F.array(F.col(x)) for x in exog})
    coef = cut_lineage(coefficients(wide, key, p, q, exog, constant, lags, pos, skip))
    ready = F.col(pos) >= skip + max(p, q)
    joined = rows.join(small_side(coef.select(key, F.col("coef").alias("_coef"))), key, "left")
    fitted = joined.withColumn("fitted", F.when(ready, F.col("_mean") + linear(p, q, exog, constant)))
    fitted = fitted.withColumn("resid", F.col(y) - F.col("fitted"))
    return ArmaResult(coef, fitted.select(*df.columns, "fitted", "resid"), key)


def solve_rows(df: DataFrame, order: int, out: str) -> DataFrame:
    """Solve one small symmetric system per row, batch by batch."""
    names = [f"_a{i}_{j}" for i in range(order) for j in range(i, order)]
    rights = [f"_r{i}" for i in range(order)]
    keep = [c for c in df.columns if c not in names + rights]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            a = np.zeros((n, order, order))
            for i in range(order):
                for j in range(i, order):
                    a[:, i, j] = a[:, j, i] = batch[f"_a{i}_{j}"].to_numpy()
            b = batch[rights].to_numpy(dtype=float)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            scaled = a / scale[:, :, None] / scale[:, None, :]
            ok = np.linalg.det(scaled) > 1e-10
            coef = np.full((n, order), np.nan)
            if ok.any():
                coef[ok] = np.linalg.solve(scaled[ok], (b / scale)[ok][:, :, None])[:, :, 0] / scale[ok]
            result = batch[keep].copy()
            result[out] = [row.tolist() if good else None for row, good in zip(coef, ok)]
            yield result

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", {out} array<double>"
    return df.mapInPandas(run, schema)


def walk_forward(
    df: DataFrame, key: str, start: int, long_order: int = 4, y: str = "y", pos: str = "pos", chunk: int | None = None
) -> DataFrame:
    """One-step forecasts of ARMA(1, 1) without constant, re-estimated before each step.

    Row t is forecast from coefficients of rows before t only. The growing sums
    behind the coefficients are running sums, so nothing is refitted from
    scratch. ``start`` is the first forecast position. Values should have mean 0.
    """
    m = long_order
    rows = with_history(df.withColumn("_d", F.col(y).cast("double")), key, ["_d"], m, pos)
    full = F.col(pos) >= m
    lag = [F.col("_h__d")[i + 1] for i in range(m)]
    cells = {f"_a{i}_{j}": F.when(full, lag[i] * lag[j]) for i in range(m) for j in range(i, m)}
    cells.update({f"_r{i}": F.when(full, lag[i] * F.col("_d")) for i in range(m)})
    growing = halo.running_sums(rows, [key], pos, cells, chunk)
    known = solve_rows(growing, m, "_phi")
    fit = F.lit(0.0)
    for i in range(m):
        fit = fit + F.col("_phi")[i] * F.col("_h__d")[i + 1]
    shocks = known.withColumn("_e", F.when(F.col("_phi").isNotNull() & full, F.col("_d") - fit))
    two = with_history(shocks.drop("_h__d", "_phi"), key, ["_d", "_e"], 1, pos)
    y1, e1 = F.col("_h__d")[1], F.col("_h__e")[1]
    use = e1.isNotNull()
    sums = {
        "_yy": F.when(use, y1 * y1), "_ye": F.when(use, y1 * e1), "_ee": F.when(use, e1 * e1),
        "_y0": F.when(use, y1 * F.col("_d")), "_e0": F.when(use, e1 * F.col("_d")),
    }
    second = halo.running_sums(two, [key], pos, sums, chunk)
    det = F.col("_yy") * F.col("_ee") - F.col("_ye") * F.col("_ye")
    safe = F.when(det > 1e-10 * F.col("_yy") * F.col("_ee"), det)
    ar = (F.col("_y0") * F.col("_ee") - F.col("_e0") * F.col("_ye")) / safe
    ma = (F.col("_e0") * F.col("_yy") - F.col("_y0") * F.col("_ye")) / safe
    out = second.withColumns({"ar": ar, "ma": ma}).withColumn("forecast", F.col("ar") * y1 + F.col("ma") * e1)
    return out.filter(F.col(pos) >= start).select(*df.columns, "ar", "ma", "forecast")
