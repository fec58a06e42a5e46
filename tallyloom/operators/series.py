"""Rolling statistics, alignment, autocorrelation and seasonal decomposition.

A series is a set of rows (keys, pos, y). ``pos`` numbers the rows of a key from
0 without holes: a grid position or the row number in time order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import halo
from tallyloom.storage import cut_lineage, small_side


def rolling(df: DataFrame, keys: list[str], y: str = "y", pos: str = "pos", width: int = 14) -> DataFrame:
    """Trailing mean and sample deviation; null until ``width`` rows exist."""
    near = halo.spread(df, pos, before=width - 1)
    w = halo.window(keys, pos).rowsBetween(-(width - 1), 0)
    full = F.count(y).over(w) == width
    out = near.withColumns(
        {
            "rolling_mean": F.when(full, F.avg(y).over(w)),
            "rolling_sd": F.when(full, F.stddev_samp(y).over(w)),
        }
    )
    return halo.home(out)


def long_form(df: DataFrame, ids: list[str], values: list[str], kind: str = "type", value: str = "y") -> DataFrame:
    """Value columns under each other, tagged by column name."""
    return df.unpivot(ids, values, kind, value)


def aligned(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Two series side by side by key and time."""
    return left.join(right, on, how)


def rebuild(df: DataFrame, parts: list[str], name: str = "rebuilt") -> DataFrame:
    """Sum of the parts, null where one is missing."""
    total: Column = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return df.withColumn(name, total)


def centred(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Add the mean, the population variance and the length of each series.

    They are a row per series, computed once and sent to the rows where few, so that a long series
    is not brought together by its key.
    """
    stats = df.groupBy(*keys).agg(
        F.avg(y).alias("_mean"), F.var_pop(y).alias("_var"), F.count(y).alias("_n")
    )
    return df.join(small_side(cut_lineage(stats)), keys)


def acf(df: DataFrame, keys: list[str], max_lag: int = 20, y: str = "y", pos: str = "pos") -> DataFrame:
    """Autocorrelation at lags 0 .. max_lag and the band 1.96 / sqrt(n)."""
    dev = centred(df, keys, y).withColumn("_d", F.col(y) - F.col("_mean"))
    near = halo.spread(dev, pos, before=max_lag)
    w = halo.window(keys, pos)
    lagged = halo.home(near.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)}))
    sums = [F.sum(F.col("_d") * F.col("_d"))] + [
        F.sum(F.col("_d") * F.col(f"_l{k}")) for k in range(1, max_lag + 1)
    ]
    rows = lagged.groupBy(*keys, "_n", "_var").agg(F.array(*sums).alias("_s"))
    flat = rows.select(*keys, "_n", "_var", F.posexplode("_s").alias("lag", "_p"))
    scale = F.col("_n") * F.col("_var")
    return flat.filter(F.col("lag") < F.col("_n")).select(
        *keys, "lag", (F.col("_p") / scale).alias("acf"), (F.lit(1.96) / F.sqrt("_n")).alias("band")
    )


def moving_trend(
    df: DataFrame, keys: list[str], period: int, two_sided: bool = True, y: str = "y", pos: str = "pos",
    weights: list[float] | None = None,
) -> DataFrame:
    """Moving average over one period; an even period halves the two end weights.

    ``weights`` replace the average by a filter of one's own, the first weight on the latest row. Null
    wherever the frame is incomplete.
    """
    if weights is not None:
        before = (len(weights) - 1) // 2 if two_sided else len(weights) - 1
        after = len(weights) - 1 - before
        near = halo.spread(df, pos, before=before, after=after)
        w = halo.window(keys, pos)
        cells = [F.lit(float(x)) * F.lead(y, after - j).over(w) for j, x in enumerate(weights)]
        return halo.home(near.withColumn("trend", reduce(lambda a, b: a + b, cells)))
    reach = period // 2
    length = period + 1 if period % 2 == 0 else period
    before, after = (reach, reach) if two_sided else (length - 1, 0)
    near = halo.spread(df, pos, before=before, after=after)
    base = halo.window(keys, pos)
    w = base.rowsBetween(-before, after)
    total = F.sum(y).over(w)
    if period % 2 == 0:
        ends = F.lag(y, before).over(base) + (F.lead(y, after).over(base) if after else F.col(y))
        total = total - ends / 2
    trend = F.when(F.count(y).over(w) == length, total / period)
    return halo.home(near.withColumn("trend", trend))


def extrapolate_trend(
    df: DataFrame, keys: list[str], points: int, trend: str = "trend", pos: str = "pos"
) -> DataFrame:
    """Fill both ends of the trend by a line through the nearest defined points.

    The front line uses the first ``points`` defined rows, the back line the
    ``points`` rows before the last defined one.
    """
    p = F.col(pos)
    known = df.filter(F.col(trend).isNotNull())
    ends = known.groupBy(*keys).agg(F.min(pos).alias("_front"), F.max(pos).alias("_back"))
    front = (p >= F.col("_front")) & (p < F.least(F.col("_front") + points, F.col("_back")))
    back = (p >= F.greatest(F.col("_front"), F.col("_back") - points)) & (p < F.col("_back"))

    def line(test: Column) -> list[Column]:
        t, x = F.when(test, F.col(trend)), F.when(test, p.cast("double"))
        return [F.regr_slope(t, x), F.regr_intercept(t, x)]

    fits = (
        known.join(small_side(cut_lineage(ends)), keys)
        .groupBy(*keys, "_front", "_back")
        .agg(*[c.alias(n) for c, n in zip(line(front) + line(back), ("_k1", "_c1", "_k2", "_c2"))])
    )
    filled = F.when(p < F.col("_front"), F.col("_k1") * p + F.col("_c1")).when(
        p > F.col("_back"), F.col("_k2") * p + F.col("_c2")
    )
    return (
        df.join(small_side(cut_lineage(fits)), keys, "left")
        .withColumn(trend, F.coalesce(F.col(trend), filled))
        .drop("_front", "_back", "_k1", "_c1", "_k2", "_c2")
    )


def seasonal_decompose(
    df: DataFrame,
    keys: list[str],
    period: int,
    model: str = "additive",
    two_sided: bool = True,
    extrapolate: int | str = 0,
    y: str = "y",
    pos: str = "pos",
    weights: list[float] | None = None,
) -> DataFrame:
    """Add trend, seasonal, resid and nobs.

    ``extrapolate`` > 0 fills the trend's ends from that many points plus one, ``"freq"`` from as many as
    the period has. ``weights`` are a filter for the trend instead of the moving average. A null, NaN or infinite value, or a value <= 0 in the multiplicative model, stops the job.
    """
    times = model.startswith("m")
    value = F.col(y).cast("double")
    sound = F.col(y).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    if times:
        sound = sound & (F.col(y) > 0)
    checked = df.withColumn(y, F.when(sound, F.col(y)).otherwise(F.raise_error(F.lit(f"unfit value in {y}"))))
    # written once: the ends, the phases and the result all read it
    out = cut_lineage(moving_trend(checked, keys, period, two_sided, y, pos, weights))
    points = period - 1 if extrapolate == "freq" else int(extrapolate)
    if points > 0:
        out = extrapolate_trend(out, keys, points + 1, pos=pos)
    detrended = F.col(y) / F.col("trend") if times else F.col(y) - F.col("trend")
    out = out.withColumn("_phase", F.col(pos) % period)
    phases = out.groupBy(*keys, "_phase").agg(F.avg(detrended).alias("_avg"), F.count(F.lit(1)).alias("_c"))
    shift = F.col("_avg") / F.col("_level") if times else F.col("_avg") - F.col("_level")
    phases = cut_lineage(phases)
    levels = phases.groupBy(*keys).agg(F.avg("_avg").alias("_level"), F.sum("_c").alias("nobs"))
    season = phases.join(small_side(cut_lineage(levels)), keys).select(*keys, "_phase", shift.alias("seasonal"), "nobs")
    joined = out.join(small_side(season), [*keys, "_phase"]).drop("_phase")
    resid = (
        F.col(y) / F.col("seasonal") / F.col("trend")
        if times
        else F.col(y) - F.col("trend") - F.col("seasonal")
    )
    return joined.withColumn("resid", resid)
