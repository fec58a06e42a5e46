"""Series operators against numpy on seeded data, with chunk borders inside the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cleaning, halo, series
from tallyloom.operators import series_models as sm

N = 300


@pytest.fixture(autouse=True)
def short_chunks(monkeypatch):
    monkeypatch.setattr(halo, "CHUNK", 37)


def frame(spark, **columns):
    rows = []
    for name, ys in columns.items():
        rows += [(name, i, float(y)) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series string, pos int, y double")


def wave(n=N, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 50 + 0.1 * t + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n)


def ar(coefs, n=N, seed=2, shocks=None):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n) if shocks is None else shocks
    y = np.zeros(n)
    for t in range(n):
        y[t] = e[t] + sum(c * y[t - i - 1] for i, c in enumerate(coefs) if t > i)
    return y


def collected(df, *columns):
    pdf = df.orderBy("series", "pos").toPandas()
    return [pdf[c].to_numpy() for c in columns]


def test_rolling_matches_pandas(spark):
    y = wave()
    mean, sd = collected(series.rolling(frame(spark, a=y), ["series"]), "rolling_mean", "rolling_sd")
    want = pd.Series(y).rolling(14)
    np.testing.assert_allclose(mean, want.mean(), rtol=1e-10)
    np.testing.assert_allclose(sd, want.std(), rtol=1e-9)


def numpy_decompose(y, period, times=False, two_sided=True):
    w = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
    trend = np.full(len(y), np.nan)
    mid = np.convolve(y, w, "valid")
    head = (len(w) - 1) // 2 if two_sided else len(w) - 1
    trend[head : head + len(mid)] = mid
    rest = y / trend if times else y - trend
    phase = np.array([np.nanmean(rest[i::period]) for i in range(period)])
    phase = phase / phase.mean() if times else phase - phase.mean()
    season = np.resize(phase, len(y))
    return trend, season, (y / season / trend if times else rest - season)


@pytest.mark.parametrize("period,model,two_sided", [(7, "additive", True), (24, "additive", True), (24, "multiplicative", True), (12, "additive", False), (7, "additive", False)])
def test_decompose(spark, period, model, two_sided):
    y = wave()
    got = collected(
        series.seasonal_decompose(frame(spark, a=y, b=y[:100] * 2), ["series"], period, model, two_sided).filter("series = 'a'"),
        "trend", "seasonal", "resid",
    )
    for a, b in zip(got, numpy_decompose(y, period, model[0] == "m", two_sided)):
        np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-9)


def test_decompose_refuses_bad_values(spark):
    with pytest.raises(Exception, match="unfit value"):
        series.seasonal_decompose(frame(spark, a=[1.0, 0.0] * 10), ["series"], 2, "multiplicative").collect()


def test_extrapolated_trend(spark):
    y = 3 + 2 * np.arange(40.0)
    out = series.seasonal_decompose(frame(spark, a=y), ["series"], 7, extrapolate=6)
    (trend,) = collected(out, "trend")
    np.testing.assert_allclose(trend, y, rtol=1e-9)


def test_extrapolation_points(spark):
    """The back line leaves out the last defined row."""
    y = wave(60)
    trend = numpy_decompose(y, 7)[0]
    (got,) = collected(series.extrapolate_trend(series.moving_trend(frame(spark, a=y), ["series"], 7), ["series"], 5), "trend")
    front, back = 3, 56
    k, c = np.polyfit(np.arange(front, front + 5), trend[front : front + 5], 1)
    np.testing.assert_allclose(got[:3], k * np.arange(3) + c, rtol=1e-8)
    k, c = np.polyfit(np.arange(back - 5, back), trend[back - 5 : back], 1)
    np.testing.assert_allclose(got[57:], k * np.arange(57, 60) + c, rtol=1e-8)


def test_acf(spark):
    y = wave()
    d = y - y.mean()
    pdf = series.acf(frame(spark, a=y), ["series"], 20).orderBy("lag").toPandas()
    want = [np.sum(d[k:] * d[: len(d) - k]) / np.sum(d * d) for k in range(21)]
    np.testing.assert_allclose(pdf["acf"], want, atol=1e-10)


def ols(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ b
    s2 = r @ r / (len(y) - x.shape[1])
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2), r @ r


def lags(y, ks, start):
    return np.column_stack([y[start - k : len(y) - k] for k in ks])


def test_pacf(spark):
    y = ar([0.6, 0.2])
    pdf = sm.pacf(frame(spark, a=y), "series", 20).orderBy("lag").toPandas()
    for k in (1, 2, 5, 20):
        x = np.column_stack([np.ones(N - k), lags(y, range(1, k + 1), k)])
        assert pdf["pacf"][k] == pytest.approx(ols(x, y[k:])[0][-1], abs=1e-8)


def numpy_adf(y, max_lag):
    dy = np.diff(y)

    def fit(p, start):
        rows = np.arange(start, len(dy))
        x = np.column_stack([np.ones(len(rows)), y[rows]] + [dy[rows - i] for i in range(1, p + 1)])
        b, se, rss = ols(x, dy[rows])
        n = len(rows)
        return b[1] / se[1], n * (np.log(2 * np.pi * rss / n) + 1) + 2 * x.shape[1], n

    best = min(range(max_lag + 1), key=lambda p: fit(p, max_lag)[1])
    stat, _, n = fit(best, best)
    return stat, best, n


@pytest.mark.parametrize("coefs", [[0.5, 0.2], [1.0], [0.3, 0.0, 0.0, 0.4]])
def test_adf(spark, coefs):
    y = 100 + ar(coefs)
    row = sm.adf(frame(spark, a=y, b=y[:50]), "series", 16).filter("series = 'a'").first()
    stat, best, n = numpy_adf(y, 16)
    assert (row["lags"], row["nobs"]) == (best, n)
    assert row["stat"] == pytest.approx(stat, abs=1e-6)
    assert row["crit_5"] == pytest.approx(-2.87, abs=0.01)


def test_unit_root_p():
    assert sm.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.002)
    assert sm.unit_root_p(-3.43) == pytest.approx(0.01, abs=0.001)
    assert sm.unit_root_p(3.0) == 1.0


def test_f_upper():
    # F(1, d) is the square of Student's t: 5 % points of t with 10 and 120 degrees are 2.228 and 1.980
    assert sm.f_upper(2.228139**2, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert sm.f_upper(1.979930**2, 1, 120) == pytest.approx(0.05, abs=1e-6)
    # F(2, d) has the closed form (1 + 2 f / d)^(-d / 2)
    assert sm.f_upper(3.0, 2, 5000) == pytest.approx((1 + 6 / 5000) ** -2500, rel=1e-8)


def test_ar_fit(spark):
    y = 20 + ar([0.5, -0.3, 0.2])
    result = sm.arma(frame(spark, a=y, b=y[::-1]), "series", 3, 0)
    rows = {r["term"]: r for r in result.summary.filter("series = 'a'").collect()}
    x = np.column_stack([np.ones(N - 3), lags(y, (1, 2, 3), 3)])
    b, se, rss = ols(x, y[3:])
    for i in (1, 2, 3):
        assert rows[f"ar{i}"]["coef"] == pytest.approx(b[i], abs=1e-8)
        assert rows[f"ar{i}"]["se"] == pytest.approx(se[i], abs=1e-8)
    fitted, resid = collected(result.fitted.filter("series = 'a'"), "fitted", "resid")
    assert np.isnan(fitted[:3].astype(float)).all()
    np.testing.assert_allclose(fitted[3:].astype(float), x @ b, atol=1e-8)
    assert np.sum(resid[3:].astype(float) ** 2) == pytest.approx(rss)


def arma_series(n, phi, theta, seed):
    e = np.random.default_rng(seed).normal(size=n)
    y = np.zeros(n)
    for t in range(n):
        y[t] = e[t] + (phi * y[t - 1] + theta * e[t - 1] if t else 0)
    return y


def test_planted_arma_and_ma(spark):
    y, z = arma_series(4000, 0.6, 0.3, 5), arma_series(4000, 0.0, 0.5, 6)
    got = {
        (r["series"], r["term"]): r["coef"]
        for r in sm.arma(frame(spark, a=y), "series", 1, 1, long_order=12).summary.collect()
        + sm.arma(frame(spark, m=z), "series", 0, 1, long_order=12).summary.collect()
    }
    assert got["a", "ar1"] == pytest.approx(0.6, abs=0.06)
    assert got["a", "ma1"] == pytest.approx(0.3, abs=0.06)
    assert got["m", "ma1"] == pytest.approx(0.5, abs=0.06)


def test_planted_armax(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=N)
    y = ar([0.5], shocks=2.0 * x + 0.1 * rng.normal(size=N))
    df = frame(spark, a=y).join(frame(spark, a=x).withColumnRenamed("y", "x"), ["series", "pos"])
    rows = {r["term"]: r["coef"] for r in sm.arma(df, "series", 1, 0, exog=["x"]).summary.collect()}
    assert rows["x"] == pytest.approx(2.0, abs=0.05)
    assert rows["ar1"] == pytest.approx(0.5, abs=0.03)


def test_granger(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=N)
    y = np.r_[0.0, 0.8 * x[:-1]] + 0.5 * rng.normal(size=N)
    df = frame(spark, caused=y, free=rng.normal(size=N)).join(
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos int, x double"), "pos"
    )
    rows = {(r["series"], r["lag"]): r for r in sm.granger(df, "series", 4).collect()}
    assert rows["caused", 1]["p_value"] < 1e-6
    assert rows["free", 1]["p_value"] > 0.01
    for k in (1, 3):
        ones = np.ones(N - k)
        own = np.column_stack([ones, lags(y, range(1, k + 1), k)])
        full = np.column_stack([own, lags(x, range(1, k + 1), k)])
        r0, r1 = ols(own, y[k:])[2], ols(full, y[k:])[2]
        want = ((r0 - r1) / k) / (r1 / (N - k - 2 * k - 1))
        assert rows["caused", k]["f_stat"] == pytest.approx(want, rel=1e-6)


def test_walk_forward_brute_force(spark):
    y = arma_series(120, 0.5, 0.3, 11)
    m = 3
    got = sm.walk_forward(frame(spark, a=y), "series", start=40, long_order=m).orderBy("pos").toPandas()
    e = np.full(len(y), np.nan)
    want = {}
    for t in range(m, len(y)):
        rows = np.arange(m, t)
        if len(rows) >= m:
            x = np.column_stack([y[rows - i] for i in range(1, m + 1)])
            g = x.T @ x
            if np.linalg.det(g / np.sqrt(np.outer(np.diag(g), np.diag(g)))) > 1e-10:
                phi = np.linalg.solve(g, x.T @ y[rows])
                e[t] = y[t] - phi @ y[t - np.arange(1, m + 1)]
        prior = [s for s in range(m + 1, t) if np.isfinite(e[s - 1])]
        if t >= 40:
            x = np.column_stack([y[np.array(prior) - 1], e[np.array(prior) - 1]])
            a, b = np.linalg.solve(x.T @ x, x.T @ y[prior])
            want[t] = a * y[t - 1] + b * e[t - 1]
    np.testing.assert_allclose(got["forecast"], [want[t] for t in got["pos"]], rtol=1e-6)


def test_running_sums_and_index(spark):
    days = pd.date_range("2020-01-01", periods=400, freq="D").delete([5, 6, 200])
    df = spark.createDataFrame([("a", d.to_pydatetime(), float(i)) for i, d in enumerate(days)], "series string, ts timestamp, y double")
    got = halo.index_rows(df, ["series"], "ts").orderBy("ts").toPandas()
    assert got["pos"].tolist() == list(range(len(days)))
    sums = halo.running_sums(halo.index_rows(df, ["series"], "ts"), ["series"], "pos", {"s": F.col("y")})
    (s,) = collected(sums, "s")
    np.testing.assert_allclose(s, np.r_[0, np.cumsum(np.arange(len(days)))[:-1]])


def test_grid_and_gaps(spark):
    hours = pd.date_range("2024-08-01", periods=48, freq="h").delete([3, 4, 30])
    df = spark.createDataFrame([("a", h.to_pydatetime(), 1.0) for h in hours], "k string, ts timestamp, y double")
    grid = cleaning.on_grid(df, ["k"], "ts", "y", "1 HOUR").orderBy("pos").toPandas()
    assert len(grid) == 48 and grid["y"].isna().sum() == 3
    assert cleaning.gaps(df, ["k"], "ts", "1 HOUR").count() == 3
    assert cleaning.on_grid(df, ["k"], "ts", "y", "1 HOUR", fill=0).agg(F.sum("y")).first()[0] == 45


def test_decomposition_refuses_infinite_values(spark):
    rows = [("s", i, float("inf") if i == 5 else float(i)) for i in range(21)]
    with pytest.raises(Exception, match="unfit value"):
        series.seasonal_decompose(spark.createDataFrame(rows, "series string, pos int, y double"), ["series"], 7).collect()


def test_own_filter_and_extrapolation_by_period(spark):
    """Weights as a convolution, both sides and one; the ends filled from a period of points."""
    rng = np.random.default_rng(11)
    y = 50 + np.arange(60) * 0.5 + 5 * np.sin(np.arange(60) * 2 * np.pi / 6) + rng.normal(size=60)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series string, pos int, y double")
    for weights in ([0.5, 0.3, 0.2], [0.4, 0.3, 0.2, 0.1], [1.0]):
        full = np.convolve(y, weights, "valid")
        for two_sided in (True, False):
            head = (len(weights) - 1) // 2 if two_sided else len(weights) - 1
            want = np.full(60, np.nan)
            want[head : head + len(full)] = full
            got = series.moving_trend(df, ["series"], 6, two_sided, weights=weights).orderBy("pos").toPandas()["trend"]
            np.testing.assert_allclose(got.astype(float), want, rtol=1e-12)
    parts = series.seasonal_decompose(df, ["series"], 6, extrapolate="freq", weights=[1 / 6] * 6).orderBy("pos").toPandas()
    trend = np.full(60, np.nan)
    trend[2:57] = np.convolve(y, [1 / 6] * 6, "valid")
    x = np.arange(60)
    for ends, fit in ((x < 2, x[2:8]), (x > 56, x[50:56])):
        trend[ends] = np.polyval(np.polyfit(fit, trend[fit], 1), x[ends])
    np.testing.assert_allclose(parts["trend"], trend, rtol=1e-9)
    assert parts["resid"].notna().all()
