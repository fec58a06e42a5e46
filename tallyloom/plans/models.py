"""Stationarity, lag models, causality and forecasts over many series at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyloom.operators import series_models as sm
from tallyloom.operators import stats
from tallyloom.plans.registry import query, steady
from tallyloom.plans.series import AR1_SQL, daily_series, hourly_series, rebuilt, rounded
from tallyloom.plans.views import Tables, event_rows, with_views

LAGGED = """lagged AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY pos) AS y1 FROM daily)"""


@query("adf_test")
def adf_test(t: Tables):
    """Unit-root test of every daily series."""
    return sm.adf(daily_series(t), "series")


@query("df_test", with_views("daily", """
SELECT series, n AS nobs, CAST(0 AS INT) AS lags, CAST(round(TRY_CAST(b / se AS DECIMAL(28,9)), 5) AS DOUBLE) AS stat,
  CAST(round(TRY_CAST(-3.43035 - 6.5393 / n - 16.786 / n ^ 2 - 79.433 / n ^ 3 AS DECIMAL(28,9)), 6) AS DOUBLE) AS crit_1 FROM (
  SELECT series, count(*) AS n, regr_slope(y - y1, y1) AS b,
    sqrt((regr_syy(y - y1, y1) - regr_sxy(y - y1, y1) ^ 2 / regr_sxx(y - y1, y1)) / (count(*) - 2) / regr_sxx(y - y1, y1)) AS se
  FROM lagged WHERE y1 IS NOT NULL GROUP BY 1)""", LAGGED))
def df_test(t: Tables):
    """The unit-root test without lagged differences."""
    return sm.adf(daily_series(t), "series", max_lag=0).select(
        "series", "nobs", "lags", steady("stat", 5).alias("stat"), steady("crit_1", 6).alias("crit_1")
    )


@query("pacf")
def pacf(t: Tables):
    """Partial autocorrelation to lag 20."""
    return sm.pacf(daily_series(t), "series")


@query("pacf_lag1", with_views("daily", """
SELECT series, CAST(1 AS INT) AS lag, CAST(round(TRY_CAST(regr_slope(y, y1) AS DECIMAL(28,9)), 6) AS DOUBLE) AS pacf FROM lagged WHERE y1 IS NOT NULL GROUP BY 1""", LAGGED))
def pacf_lag1(t: Tables):
    """The first lag, which is a plain regression slope."""
    return rounded(sm.pacf(daily_series(t), "series", max_lag=1).filter("lag = 1").drop("band"), "pacf")


@query("ar_fit")
def ar_fit(t: Tables):
    """AR(3) coefficients with standard errors."""
    return sm.arma(daily_series(t), "series", 3, 0).summary


@query("ar1_fit", with_views("daily", """
SELECT series, 'ar1' AS term, count(*) AS nobs, CAST(round(TRY_CAST(regr_slope(y, y1) AS DECIMAL(28,9)), 6) AS DOUBLE) AS coef,
  CAST(round(TRY_CAST(sqrt((regr_syy(y, y1) - regr_sxy(y, y1) ^ 2 / regr_sxx(y, y1)) / (count(*) - 2) / regr_sxx(y, y1)) AS DECIMAL(28,9)), 6) AS DOUBLE) AS se
FROM lagged WHERE y1 IS NOT NULL GROUP BY 1""", LAGGED))
def ar1_fit(t: Tables):
    """AR(1) with constant: slope and standard error."""
    s = sm.arma(daily_series(t), "series", 1, 0).summary.filter("term = 'ar1'")
    return rounded(s.drop("t"), "coef", "se")


@query("ar_fitted")
def ar_fitted(t: Tables):
    """Fitted values and residuals of AR(3)."""
    return sm.arma(daily_series(t), "series", 3, 0).fitted


@query("ma_fit")
def ma_fit(t: Tables):
    """MA(4) coefficients."""
    return sm.arma(daily_series(t), "series", 0, 4).summary


@query("arma_fit")
def arma_fit(t: Tables):
    """ARMA(3, 4) coefficients of daily series."""
    return sm.arma(daily_series(t), "series", 3, 4).summary


@query("arma_fit_hourly")
def arma_fit_hourly(t: Tables):
    """ARMA(3, 6) coefficients of hourly series."""
    return sm.arma(hourly_series(t), "series", 3, 6).summary


ARMA11_SQL = """c AS (SELECT h.series, h.pos, h.y - m.mu AS d FROM hourly h JOIN (
  SELECT series, avg(y) AS mu FROM hourly GROUP BY 1) m ON m.series = h.series),
l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM c WINDOW w AS (PARTITION BY series ORDER BY pos)),
g AS (SELECT series, sum(d1 * d1) AS a, sum(d1 * d2) AS b, sum(d2 * d2) AS e, sum(d1 * d) AS r, sum(d2 * d) AS s
  FROM l WHERE pos >= 2 GROUP BY 1),
phi AS (SELECT series, (r * e - s * b) / (a * e - b * b) AS f1, (s * a - r * b) / (a * e - b * b) AS f2 FROM g),
sh AS (SELECT l.series, pos, d, d1, CASE WHEN pos >= 2 THEN d - f1 * d1 - f2 * d2 END AS e
  FROM l JOIN phi ON phi.series = l.series),
sl AS (SELECT *, lag(e) OVER (PARTITION BY series ORDER BY pos) AS e1 FROM sh)"""


def hourly_deviations(t: Tables):
    return sm.deviations(hourly_series(t), "series", "y", "d").select("series", "pos", "d")


@query("arma_11_fit", with_views("hourly", """
SELECT series, count(*) AS nobs,
  CAST(round(TRY_CAST((sum(d1 * d) * sum(e1 * e1) - sum(e1 * d) * sum(d1 * e1)) / (sum(d1 * d1) * sum(e1 * e1) - sum(d1 * e1) ^ 2) AS DECIMAL(28,9)), 5) AS DOUBLE) AS ar1,
  CAST(round(TRY_CAST((sum(e1 * d) * sum(d1 * d1) - sum(d1 * d) * sum(d1 * e1)) / (sum(d1 * d1) * sum(e1 * e1) - sum(d1 * e1) ^ 2) AS DECIMAL(28,9)), 5) AS DOUBLE) AS ma1
FROM sl WHERE pos >= 3 GROUP BY 1""", ARMA11_SQL))
def arma_11_fit(t: Tables):
    """ARMA(1, 1) without constant, shocks from an AR(2)."""
    s = sm.arma(hourly_deviations(t), "series", 1, 1, constant=False, long_order=2, y="d").summary
    return s.groupBy("series", "nobs").agg(
        steady(F.max(F.when(F.col("term") == "ar1", F.col("coef"))), 5).alias("ar1"),
        steady(F.max(F.when(F.col("term") == "ma1", F.col("coef"))), 5).alias("ma1"),
    )


@query("armax_fit")
def armax_fit(t: Tables):
    """ARMA(1, 1) of hourly counts with the hourly mean value as exogenous series."""
    extra = event_rows(t).groupBy("series", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("level"))
    both = hourly_series(t).join(extra, ["series", "ts"], "left").na.fill(0.0, ["level"])
    return sm.arma(both, "series", 1, 1, exog=["level"]).summary


PAIRED = """paired AS (SELECT a.series, a.pos, a.y, lag(a.y) OVER w AS y1, lag(b.y) OVER w AS x1
  FROM hourly a JOIN hourly b ON b.series = 'view' AND b.ts = a.ts WHERE a.series <> 'view'
  WINDOW w AS (PARTITION BY a.series ORDER BY a.pos))"""


def hourly_pairs(t: Tables):
    """Each event type beside the hourly views, aligned on the hour and numbered afresh."""
    from tallyloom.operators.halo import index_rows

    h = hourly_series(t)
    views = h.filter("series = 'view'").select("ts", F.col("y").alias("x"))
    both = h.filter("series <> 'view'").select("series", "ts", "y").join(views, "ts")
    return index_rows(both, ["series"], "ts")


@query("granger_test")
def granger_test(t: Tables):
    """Do hourly views help to predict the other event counts? Lags 1 to 10."""
    return sm.granger(hourly_pairs(t), "series")


@query("granger_lag1", with_views("hourly", """
SELECT series, n - 3 AS df_den, CAST(round(TRY_CAST((r2u - r2r) / ((1 - r2u) / (n - 3)) AS DECIMAL(28,9)), 4) AS DOUBLE) AS f_stat FROM (
  SELECT series, n, a * a AS r2r, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2u FROM (
    SELECT series, count(*) AS n, corr(y, y1) AS a, corr(y, x1) AS b, corr(y1, x1) AS c
    FROM paired WHERE y1 IS NOT NULL GROUP BY 1))""", PAIRED))
def granger_lag1(t: Tables):
    """The causality test at lag 1, where the two fits have a closed form."""
    g = sm.granger(hourly_pairs(t), "series", max_lag=1)
    return g.select("series", "df_den", steady("f_stat", 4).alias("f_stat"))


@query("walk_forward", with_views("hourly", """
SELECT series, pos, CAST(round(TRY_CAST(CASE WHEN det > 1e-10 * yy * ee THEN (y0 * ee - e0 * ye) / det * d1 + (e0 * yy - y0 * ye) / det * e1 END AS DECIMAL(28,9)), 5) AS DOUBLE) AS forecast
FROM (SELECT *, yy * ee - ye * ye AS det FROM (
  SELECT series, pos, d1, e1, sum(d1 * d1) FILTER (e1 IS NOT NULL) OVER w AS yy, sum(d1 * e1) OVER w AS ye, sum(e1 * e1) OVER w AS ee,
    sum(d1 * d) FILTER (e1 IS NOT NULL) OVER w AS y0, sum(e1 * d) OVER w AS e0 FROM wl
  WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE pos >= 48""", """
c AS (SELECT h.series, h.pos, h.y - m.mu AS d FROM hourly h JOIN (
  SELECT series, avg(y) AS mu FROM hourly GROUP BY 1) m ON m.series = h.series),
l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM c WINDOW w AS (PARTITION BY series ORDER BY pos)),
g AS (SELECT *, sum(d1 * d1) FILTER (pos >= 2) OVER w AS a, sum(d1 * d2) OVER w AS b, sum(d2 * d2) OVER w AS e,
    sum(d1 * d) FILTER (pos >= 2) OVER w AS r, sum(d2 * d) OVER w AS s FROM l
  WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
we AS (SELECT series, pos, d, d1, CASE WHEN pos >= 2 AND 1 - b * b / (a * e) > 1e-10
    THEN d - (r * e - s * b) / (a * e - b * b) * d1 - (s * a - r * b) / (a * e - b * b) * d2 END AS sh FROM g),
wl AS (SELECT *, lag(sh) OVER (PARTITION BY series ORDER BY pos) AS e1 FROM we)"""))
def walk_forward(t: Tables):
    """One-step forecasts from ARMA(1, 1) re-estimated before each hour."""
    f = sm.walk_forward(hourly_deviations(t), "series", start=48, long_order=2, y="d")
    return rounded(f.select("series", "pos", "forecast"), "forecast", places=5)


@query("walk_forward_error")
def walk_forward_error(t: Tables):
    """Squared error of the forecasts with a longer first stage, per series."""
    f = sm.walk_forward(hourly_deviations(t), "series", start=48, long_order=4, y="d")
    return stats.fit_errors(f, "d", "forecast", "series")


def normal_sql(z: str) -> str:
    """The distribution function of the library as text."""
    x = f"abs({z})"
    above, below = (reduce(lambda total, c: f"({total} * {x} + {c!r})", v[1:], repr(v[0])) for v in (stats.NORMAL_ABOVE, stats.NORMAL_BELOW))
    far = reduce(lambda under, k: f"({x} + {k}.0 / {under})", (4, 3, 2, 1), f"({x} + 0.65)")
    tail = f"CASE WHEN {x} < {stats.NORMAL_FAR!r} THEN exp(-{x} * {x} / 2) * {above} / {below} ELSE exp(-{x} * {x} / 2) / {far} / 2.506628274631 END"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


RESIDUALS = AR1_SQL + """,
rest AS (SELECT series, resid - fitted AS e FROM built WHERE fitted IS NOT NULL)"""


@query("residual_ks", with_views("daily", f"""
SELECT series, n, CAST(round(TRY_CAST(ks AS DECIMAL(28,9)), 6) AS DOUBLE) AS ks,
  CAST(round(TRY_CAST(least(greatest(2 * list_sum(list_transform(range(1, 21),
    lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * l * l))), 0.0), 1.0) AS DECIMAL(28,9)), 6) AS DOUBLE) AS ks_p,
  CAST(round(TRY_CAST(ad AS DECIMAL(28,9)), 5) AS DOUBLE) AS ad
FROM (SELECT *, ks * (sqrt(n) + 0.12 + 0.11 / sqrt(n)) AS l FROM (
  SELECT series, n, max(greatest(i / CAST(n AS DOUBLE) - f, f - (i - 1) / CAST(n AS DOUBLE))) AS ks,
    -n - sum((2 * i - 1) * ln(greatest(f, 1e-300)) + (2 * (n - i) + 1) * ln(greatest(g, 1e-300))) / n AS ad
  FROM (SELECT series, n, i, {normal_sql("z")} AS f, {normal_sql("(-z)")} AS g FROM (
    SELECT series, row_number() OVER (PARTITION BY series ORDER BY e) AS i, count(*) OVER (PARTITION BY series) AS n,
      (e - avg(e) OVER (PARTITION BY series)) / stddev_samp(e) OVER (PARTITION BY series) AS z FROM rest)) GROUP BY 1, 2))""", RESIDUALS))
def residual_ks(t: Tables):
    """Kolmogorov-Smirnov and Anderson-Darling tests of the AR(1) residuals of every series against a fitted normal."""
    found = stats.normality(residuals(t), "resid", "series")
    return rounded(rounded(found.select("series", "n", "ks", "ks_p", "ad"), "ks", "ks_p"), "ad", places=5)


def residuals(t: Tables):
    rest = rebuilt(t).select("series", (F.col("rest") - F.col("fitted")).alias("resid"))
    return rest.filter("resid IS NOT NULL")


@query("residual_normality", with_views("daily", """
SELECT series, n, CAST(round(TRY_CAST(g AS DECIMAL(28,9)), 6) AS DOUBLE) AS skew, CAST(round(TRY_CAST(k AS DECIMAL(28,9)), 6) AS DOUBLE) AS kurt, CAST(round(TRY_CAST(n / 6.0 * (g * g + k * k / 4) AS DECIMAL(28,9)), 4) AS DOUBLE) AS jb,
  CAST(round(TRY_CAST(exp(-(n / 6.0 * (g * g + k * k / 4)) / 2) AS DECIMAL(28,9)), 6) AS DOUBLE) AS p_value
FROM (SELECT series, count(*) AS n, avg((e - m) ^ 3) / avg((e - m) ^ 2) ^ 1.5 AS g,
        avg((e - m) ^ 4) / avg((e - m) ^ 2) ^ 2 - 3 AS k
      FROM (SELECT series, e, avg(e) OVER (PARTITION BY series) AS m FROM rest) GROUP BY 1)""", RESIDUALS))
def residual_normality(t: Tables):
    """Jarque-Bera test of the AR(1) residuals of every series."""
    jb = stats.jarque_bera(residuals(t), "resid", "series")
    return rounded(rounded(jb, "skew", "kurt", "p_value"), "jb", places=4)
