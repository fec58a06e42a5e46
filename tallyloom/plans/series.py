"""Series on grids: rolling statistics, decomposition, autocorrelation, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import cleaning, counts, halo, series, stats
from tallyloom.plans.registry import query, steady
from tallyloom.plans.views import SQL, NEEDS, Tables, event_rows, posts, with_views

GRID = """{name}_span AS (SELECT {key} AS series, CAST(min({t}) AS TIMESTAMP) AS lo, CAST(max({t}) AS TIMESTAMP) AS hi FROM {src} GROUP BY 1),
{name}_grid AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL {step})) AS {kind}) AS ts FROM {name}_span),
{name} AS (
  SELECT g.series, g.ts, CAST(coalesce(c.n, 0) AS DOUBLE) AS y,
         CAST(row_number() OVER (PARTITION BY g.series ORDER BY g.ts) - 1 AS INT) AS pos
  FROM {name}_grid g LEFT JOIN (SELECT {key} AS series, {t} AS ts, count(*) AS n FROM {src} GROUP BY 1, 2) c
    ON c.series = g.series AND c.ts = g.ts)"""

SQL["daily"] = GRID.format(name="daily", key="language", t="day", src="posts", step="1 DAY", kind="DATE")
SQL["monthly"] = GRID.format(
    name="monthly", key="language", t="CAST(date_trunc('month', day) AS DATE)", src="posts", step="1 MONTH", kind="DATE"
)
SQL["hourly"] = GRID.format(
    name="hourly", key="series", t="date_trunc('hour', ts)", src="event_rows", step="1 HOUR", kind="TIMESTAMP"
)
NEEDS.update({"daily": ("posts",), "monthly": ("posts",), "hourly": ("event_rows",)})


def daily_series(t: Tables) -> DataFrame:
    """Posts per language and day on the full daily grid, 0 on days without posts."""
    n = counts.count_by(posts(t).select(F.col("language").alias("series"), F.col("day").alias("ts")), "series", "ts", name="y")
    return cleaning.on_grid(n, ["series"], "ts", "y", "1 DAY", fill=0)


def monthly_series(t: Tables) -> DataFrame:
    month = F.trunc("day", "month").alias("ts")
    n = counts.count_by(posts(t).select(F.col("language").alias("series"), month), "series", "ts", name="y")
    return cleaning.on_grid(n, ["series"], "ts", "y", "1 MONTH", fill=0)


def hourly_series(t: Tables) -> DataFrame:
    """Events per type and hour on the full hourly grid."""
    hour = F.date_trunc("hour", "ts").alias("ts")
    n = counts.count_by(event_rows(t).select("series", hour), "series", "ts", name="y")
    return cleaning.on_grid(n, ["series"], "ts", "y", "1 HOUR", fill=0)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: steady(c, places) for c in columns})


def rolled(t: Tables) -> DataFrame:
    """Counts of the days that have posts: rows, not grid steps, as in a plain daily count."""
    days = posts(t).groupBy(F.col("language").alias("series"), "day").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return series.rolling(halo.index_rows(days, ["series"], "day"), ["series"])


ROLLED_SQL = """days AS (SELECT language AS series, day, CAST(count(*) AS DOUBLE) AS y FROM posts GROUP BY 1, 2),
rolled AS (SELECT series, day, y, CASE WHEN count(*) OVER w = 14 THEN avg(y) OVER w END AS rolling_mean,
  CASE WHEN count(*) OVER w = 14 THEN stddev_samp(y) OVER w END AS rolling_sd
  FROM days WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


@query("rolling_stats", with_views("posts", """
SELECT series, day, y, CAST(round(TRY_CAST(rolling_mean AS DECIMAL(28,9)), 6) AS DOUBLE) AS rolling_mean, CAST(round(TRY_CAST(rolling_sd AS DECIMAL(28,9)), 6) AS DOUBLE) AS rolling_sd FROM rolled""", ROLLED_SQL))
def rolling_stats(t: Tables):
    """Trailing mean and deviation over 14 rows; empty for the first 13."""
    return rounded(rolled(t).drop("pos"), "rolling_mean", "rolling_sd")


@query("rolling_long", with_views("posts", """
SELECT series, day, 'y' AS type, y AS value FROM rolled
UNION ALL SELECT series, day, 'rolling_mean', CAST(round(TRY_CAST(rolling_mean AS DECIMAL(28,9)), 6) AS DOUBLE) FROM rolled
UNION ALL SELECT series, day, 'rolling_sd', CAST(round(TRY_CAST(rolling_sd AS DECIMAL(28,9)), 6) AS DOUBLE) FROM rolled""", ROLLED_SQL))
def rolling_long(t: Tables):
    """The three rolling columns under each other, tagged."""
    long = series.long_form(rolled(t), ["series", "day"], ["y", "rolling_mean", "rolling_sd"], value="value")
    return rounded(long, "value")


def decomposition_sql(
    source: str, period: int, times: bool = False, one_sided: bool = False, name: str = "parts", ends: int = 0
) -> str:
    """CTEs of a classical decomposition with plain windows, for comparison; ``ends``: points of the lines that
    fill both ends of the trend."""
    reach = period // 2
    length = period + 1 if period % 2 == 0 else period
    before, after = (length - 1, 0) if one_sided else (reach, reach)
    total = f"sum(y) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    if period % 2 == 0:
        last = f"lead(y, {after}) OVER o" if after else "y"
        total = f"({total} - (lag(y, {before}) OVER o + {last}) / 2)"
    n = f"count(*) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    minus, level = ("/", "/") if times else ("-", "-")
    resid = "y / seasonal / trend" if times else "y - trend - seasonal"
    first = f"{name}_m" if ends else f"{name}_t"
    line = lambda end: f"regr_slope(trend, pos) FILTER ({end}) AS k, regr_intercept(trend, pos) FILTER ({end}) AS c"
    front, back = f"pos >= fr AND pos < least(fr + {ends}, bk)", f"pos >= greatest(fr, bk - {ends}) AND pos < bk"
    filled = f"""{name}_e AS (SELECT *, min(CASE WHEN trend IS NOT NULL THEN pos END) OVER (PARTITION BY series) AS fr,
  max(CASE WHEN trend IS NOT NULL THEN pos END) OVER (PARTITION BY series) AS bk FROM {name}_m),
{name}_a AS (SELECT series, {line(front)} FROM {name}_e WHERE trend IS NOT NULL GROUP BY 1),
{name}_z AS (SELECT series, {line(back)} FROM {name}_e WHERE trend IS NOT NULL GROUP BY 1),
{name}_t AS (SELECT e.* REPLACE (CASE WHEN pos < fr THEN a.k * pos + a.c WHEN pos > bk THEN z.k * pos + z.c ELSE trend END AS trend)
  FROM {name}_e e JOIN {name}_a a ON a.series = e.series JOIN {name}_z z ON z.series = e.series),
""" if ends else ""
    return f"""{first} AS (
  SELECT *, CASE WHEN {n} = {length} THEN {total} / {period} END AS trend
  FROM {source} WINDOW o AS (PARTITION BY series ORDER BY pos)),
{filled}{name}_p AS (SELECT series, pos % {period} AS phase, avg(y {minus} trend) AS a FROM {name}_t GROUP BY 1, 2),
{name}_s AS (SELECT series, phase, a {level} avg(a) OVER (PARTITION BY series) AS seasonal FROM {name}_p),
{name} AS (SELECT *, {resid} AS resid FROM (
  SELECT t.*, s.seasonal FROM {name}_t t JOIN {name}_s s ON s.series = t.series AND s.phase = t.pos % {period}))"""


PARTS_OUT = """
SELECT series, pos, y, CAST(round(TRY_CAST(trend AS DECIMAL(28,9)), 6) AS DOUBLE) AS trend, CAST(round(TRY_CAST(seasonal AS DECIMAL(28,9)), 6) AS DOUBLE) AS seasonal, CAST(round(TRY_CAST(resid AS DECIMAL(28,9)), 6) AS DOUBLE) AS resid FROM parts"""


def parts_out(df: DataFrame) -> DataFrame:
    return rounded(df.select("series", "pos", "y", "trend", "seasonal", "resid"), "trend", "seasonal", "resid")


@query("seasonal_decompose", with_views("daily", PARTS_OUT, decomposition_sql("daily", 7)))
def seasonal_decompose(t: Tables):
    """Trend, weekly pattern and rest of daily counts, all languages at once."""
    return parts_out(series.seasonal_decompose(daily_series(t), ["series"], 7))


@query("seasonal_decompose_freq", with_views("daily", PARTS_OUT, decomposition_sql("daily", 7, ends=7)))
def seasonal_decompose_freq(t: Tables):
    """The ends of the trend filled from as many points as the period has."""
    return parts_out(series.seasonal_decompose(daily_series(t), ["series"], 7, extrapolate="freq"))


@query("seasonal_decompose_hourly", with_views("hourly", PARTS_OUT, decomposition_sql("hourly", 24)))
def seasonal_decompose_hourly(t: Tables):
    """The same for hourly counts with an even period."""
    return parts_out(series.seasonal_decompose(hourly_series(t), ["series"], 24))


@query("seasonal_decompose_onesided", with_views("hourly", PARTS_OUT, decomposition_sql("hourly", 24, one_sided=True)))
def seasonal_decompose_onesided(t: Tables):
    """The trend looks back only."""
    return parts_out(series.seasonal_decompose(hourly_series(t), ["series"], 24, two_sided=False))


@query("seasonal_decompose_mult", with_views("monthly", PARTS_OUT, decomposition_sql("monthly", 12, times=True)))
def seasonal_decompose_mult(t: Tables):
    """Multiplicative decomposition of monthly counts."""
    return parts_out(series.seasonal_decompose(monthly_series(t), ["series"], 12, model="multiplicative"))


@query("trend_extrapolate", with_views("daily", """
SELECT d.series, d.pos, CAST(round(TRY_CAST(coalesce(d.trend, CASE WHEN d.pos < f.front THEN f.k1 * d.pos + f.c1 ELSE f.k2 * d.pos + f.c2 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS trend
FROM parts_t d JOIN fits f ON f.series = d.series""", decomposition_sql("daily", 7) + """,
ends AS (SELECT series, min(pos) AS front, max(pos) AS back FROM parts_t WHERE trend IS NOT NULL GROUP BY 1),
fits AS (SELECT e.series, e.front, e.back,
  regr_slope(trend, pos) FILTER (pos >= front AND pos < least(front + 7, back)) AS k1,
  regr_intercept(trend, pos) FILTER (pos >= front AND pos < least(front + 7, back)) AS c1,
  regr_slope(trend, pos) FILTER (pos >= greatest(front, back - 7) AND pos < back) AS k2,
  regr_intercept(trend, pos) FILTER (pos >= greatest(front, back - 7) AND pos < back) AS c2
  FROM ends e JOIN parts_t d ON d.series = e.series WHERE trend IS NOT NULL GROUP BY 1, 2, 3)"""))
def trend_extrapolate(t: Tables):
    """Both ends of the trend filled by a line through the nearest points."""
    trend = series.moving_trend(daily_series(t), ["series"], 7)
    return rounded(series.extrapolate_trend(trend, ["series"], 7).select("series", "pos", "trend"), "trend")


@query("acf", with_views("daily", """
SELECT a.series, CAST(lags.k AS INT) AS lag, CAST(round(TRY_CAST(sum((a.y - m.mu) * (b.y - m.mu)) / any_value(m.n * m.v) AS DECIMAL(28,9)), 6) AS DOUBLE) AS acf,
  CAST(round(TRY_CAST(1.96 / sqrt(any_value(m.n)) AS DECIMAL(28,9)), 6) AS DOUBLE) AS band
FROM daily a JOIN (SELECT unnest(range(0, 21)) AS k) lags ON true
JOIN daily b ON b.series = a.series AND b.pos = a.pos - lags.k
JOIN (SELECT series, avg(y) AS mu, var_pop(y) AS v, count(*) AS n FROM daily GROUP BY 1) m ON m.series = a.series
GROUP BY 1, 2"""))
def acf(t: Tables):
    """Autocorrelation to lag 20 with its band."""
    return rounded(series.acf(daily_series(t), ["series"]), "acf", "band")


@query("series_align_corr", with_views("posts", """
WITH d AS (SELECT day, language, count(*) AS n FROM posts GROUP BY 1, 2), al AS (SELECT day, count(*) AS n FROM posts GROUP BY 1)
SELECT 'high-urgent' AS pair, CAST(round(TRY_CAST(corr(a.n, b.n) AS DECIMAL(28,9)), 6) AS DOUBLE) AS r, count(*) AS days
  FROM d a JOIN d b USING (day) WHERE a.language = '1-URGENT' AND b.language = '2-HIGH'
UNION ALL SELECT 'all-urgent', CAST(round(TRY_CAST(corr(a.n, al.n) AS DECIMAL(28,9)), 6) AS DOUBLE), count(*) FROM d a JOIN al USING (day) WHERE a.language = '1-URGENT'
UNION ALL SELECT 'all-high', CAST(round(TRY_CAST(corr(a.n, al.n) AS DECIMAL(28,9)), 6) AS DOUBLE), count(*) FROM d a JOIN al USING (day) WHERE a.language = '2-HIGH'
""").replace("\nWITH d AS", ",\nd AS"))
def series_align_corr(t: Tables):
    """Correlations of daily series aligned on the day (inner)."""
    p = posts(t)
    every = counts.count_by(p, "day", name="all")
    urgent = counts.count_by(p.filter("language = '1-URGENT'"), "day", name="urgent")
    high = counts.count_by(p.filter("language = '2-HIGH'"), "day", name="high")
    full = series.aligned(series.aligned(every, urgent, ["day"], "left"), high, ["day"], "left")
    pairs = [("high", "urgent"), ("all", "urgent"), ("all", "high")]
    cells = [
        F.struct(
            F.lit(f"{a}-{b}").alias("pair"),
            steady(F.corr(a, b), 6).alias("r"),
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("days"),
        )
        for a, b in pairs
    ]
    return full.agg(F.array(*cells).alias("c")).select(F.inline("c"))


AR1_SQL = decomposition_sql("daily", 7) + """,
pairs AS (SELECT *, lag(resid) OVER (PARTITION BY series ORDER BY pos) AS r1 FROM parts WHERE resid IS NOT NULL),
phi AS (SELECT series, sum(resid * r1) / sum(r1 * r1) AS phi FROM pairs WHERE r1 IS NOT NULL GROUP BY 1),
built AS (SELECT p.series, p.pos, p.y, p.resid, phi * r1 AS fitted, phi * r1 + trend + seasonal AS rebuilt
  FROM pairs p JOIN phi f ON f.series = p.series)"""


def rebuilt(t: Tables) -> DataFrame:
    """AR(1) without constant on the rest of the decomposition, added back to trend and season."""
    from tallyloom.operators.series_models import arma

    parts = series.seasonal_decompose(daily_series(t), ["series"], 7).filter(F.col("resid").isNotNull())
    rest = parts.withColumnsRenamed({"pos": "grid_pos", "resid": "rest"})
    # the moving trend loses three rows at the start, so positions shift by three
    rest = rest.withColumn("pos", F.col("grid_pos") - 3)
    model = arma(rest, "series", 1, 0, constant=False, y="rest")
    return series.rebuild(model.fitted, ["fitted", "trend", "seasonal"])


@query("series_rebuild", with_views("daily", """
SELECT series, pos, CAST(round(TRY_CAST(fitted AS DECIMAL(28,9)), 6) AS DOUBLE) AS fitted, CAST(round(TRY_CAST(rebuilt AS DECIMAL(28,9)), 6) AS DOUBLE) AS rebuilt FROM built""", AR1_SQL))
def series_rebuild(t: Tables):
    out = rebuilt(t).select("series", F.col("grid_pos").alias("pos"), "fitted", "rebuilt")
    return rounded(out, "fitted", "rebuilt")


@query("series_rss", with_views("daily", """
SELECT series, count(rebuilt) AS n, CAST(round(TRY_CAST(sum((y - rebuilt) ^ 2) AS DECIMAL(28,9)), 4) AS DOUBLE) AS rss, CAST(round(TRY_CAST(avg((y - rebuilt) ^ 2) AS DECIMAL(28,9)), 6) AS DOUBLE) AS mse
FROM built GROUP BY 1""", AR1_SQL))
def series_rss(t: Tables):
    """Squared error of the rebuilt signal, per series."""
    e = stats.fit_errors(rebuilt(t), "y", "rebuilt", "series")
    return e.select("series", "n", steady("rss", 4).alias("rss"), steady("mse", 6).alias("mse"))


@query("series_long", with_views("daily", """
SELECT series, pos, 'actual' AS type, CAST(round(TRY_CAST(resid AS DECIMAL(28,9)), 6) AS DOUBLE) AS value FROM built
UNION ALL SELECT series, pos, 'fitted', CAST(round(TRY_CAST(fitted AS DECIMAL(28,9)), 6) AS DOUBLE) FROM built""", AR1_SQL))
def series_long(t: Tables):
    """Actual and fitted values under each other, tagged."""
    r = rebuilt(t).select("series", F.col("grid_pos").alias("pos"), F.col("rest").alias("actual"), "fitted")
    return rounded(series.long_form(r, ["series", "pos"], ["actual", "fitted"], value="value"), "value")
