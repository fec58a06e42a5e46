"""Summary statistics, exact quantiles, bounds and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.storage import cut_lineage, small_side

SPLITS = 64


def with_group_row(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the one row of each group; without keys the single row is a scalar subquery.

    The group rows are written once. A list that passes the size check is
    broadcast, so the rows of a hot group are not shuffled; a longer one joins by
    shuffle.
    """
    if keys:
        return df.join(small_side(cut_lineage(per_group)), keys)
    row = per_group.select(F.struct("*")).scalar()
    return df.withColumn("_row", row).select("*", "_row.*").drop("_row")


def engagement(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sum, mean, sample deviation, greatest and smallest value per group, in one pass."""
    return df.groupBy(group).agg(
        F.sum(value).alias("total"),
        F.avg(F.col(value).cast("double")).alias("mean"),
        F.stddev_samp(F.col(value).cast("double")).alias("sd"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, min and max as typed columns, one row per input column."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    )
    return (
        df.select(rows.alias("r"))
        .select("r.column", "r.v")
        .groupBy("column")
        .agg(
            F.count("v").alias("n"),
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("sd"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
    )


def pairwise_corr(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Pearson correlation of all column pairs, per key, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs
    ]
    return df.groupBy(*keys).agg(F.array(*cells).alias("m")).select(*keys, F.inline("m"))


def mean_bounds(df: DataFrame, value: str, *keys: str, width: float = 2.0) -> DataFrame:
    """mean - width * sd and mean + width * sd per key."""
    v = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return stats.withColumn("low", F.col("mean") - width * F.col("sd")).withColumn(
        "high", F.col("mean") + width * F.col("sd")
    )


def beyond_bounds(df: DataFrame, value: str, *keys: str, width: float = 2.0) -> DataFrame:
    """Rows above the upper or below the lower bound, marked by ``tail``."""
    bounds = mean_bounds(df, value, *keys, width=width).select(*keys, "low", "high")
    joined = with_group_row(df, bounds, list(keys))
    tail = F.when(F.col(value) > F.col("high"), "high").when(F.col(value) < F.col("low"), "low")
    return joined.withColumn("tail", tail).filter(F.col("tail").isNotNull())


def tail_shares(df: DataFrame, score: str, cut: float) -> DataFrame:
    """Parts of rows below -cut, below 0, above 0 and above cut, in one pass."""
    s = F.col(score)

    def part(test: Column) -> Column:
        return F.avg(F.when(test, 1.0).otherwise(0.0))

    return df.filter(s.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        part(s < -cut).alias("very_negative"),
        part(s < 0).alias("negative"),
        part(s > 0).alias("positive"),
        part(s > cut).alias("very_positive"),
    )


def count_below(points: Column, value: Column, splits: int) -> Column:
    """How many of ``splits - 1`` ascending points are less than the value, by halving; splits is a power of 2."""
    at, step = F.lit(0), splits // 2
    while step:
        at = at + F.when(F.get(points, at + F.lit(step - 1)) < value, step).otherwise(0)
        step //= 2
    return at


def ranked_values(df: DataFrame, value: str, keys: list[str], splits: int = SPLITS) -> DataFrame:
    """(keys, n, _v, _c, _lo, _hi): the different values of each group, how often each is there, and
    the ranks it covers (from _lo on, _hi not included), without gathering a group in one task.

    Equal values are merged first. Approximate split points cut each group into
    buckets of distinct values; ranks are counted inside the buckets on top of
    the bucket totals.
    """
    vc = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cuts = [i / splits for i in range(1, splits)]
    edges = vc.groupBy(*keys).agg(
        F.percentile_approx("_v", cuts, F.lit(1000)).alias("_edges"), F.sum("_c").alias("n")
    )
    marked = with_group_row(vc, edges, keys)
    marked = marked.withColumn("_b", count_below(F.col("_edges"), F.col("_v"), splits)).drop("_edges")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        marked.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .select(*keys, "_b", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_base"))
    )
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(bases, [*keys, "_b"])
        .withColumn("_hi", F.col("_base") + F.sum("_c").over(inner))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )


def exact_quantiles(
    df: DataFrame, value: str, keys: list[str], probs: dict[str, float], splits: int = SPLITS
) -> DataFrame:
    """Exact interpolated quantiles; only the values at the wanted ranks are kept."""
    placed = ranked_values(df, value, keys, splits)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    out = []
    for name, p in probs.items():
        spot = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        out += [at(low).alias(f"_{name}_a"), at(high).alias(f"_{name}_b")]
    found = placed.groupBy(*keys, "n").agg(*out)
    cells = []
    for name, p in probs.items():
        spot = (F.col("n") - 1) * F.lit(float(p))
        part = spot - F.floor(spot)
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        cells.append((a + (b - a) * part).alias(name))
    return found.select(*keys, "n", *cells)


def boxplot(df: DataFrame, value: str, keys: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends inside ``reach`` * IQR, extremes and number of outliers."""
    q = exact_quantiles(df, value, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    q = q.withColumn("_low", F.col("q1") - reach * spread).withColumn("_high", F.col("q3") + reach * spread)
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    joined = with_group_row(v, q, keys)
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    return joined.groupBy(*keys, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        F.count_if(~inside).alias("outliers"),
    )


def fit_errors(df: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    """RSS, MSE, RMSE, MAE and R2 of paired values, per key, in one aggregation."""
    a, p = F.col(actual), F.col(predicted)
    both = df.filter(a.isNotNull() & p.isNotNull())
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((a - p) * (a - p)).alias("rss"),
        F.avg((a - p) * (a - p)).alias("mse"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
        (F.var_pop(a) * F.count(F.lit(1))).alias("_tss"),
    )
    return sums.withColumn("r2", 1 - F.col("rss") / F.col("_tss")).drop("_tss")


def jarque_bera(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Skewness, excess kurtosis, the Jarque-Bera statistic and its chi-square(2) p-value."""
    v = F.col(value)
    m = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt")
    )
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)
    return m.withColumn("jb", jb).withColumn("p_value", F.exp(-jb / 2.0))


# Coefficients of the normal distribution function (Hart, algorithm 5666), highest power first.
NORMAL_ABOVE = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376
)
NORMAL_BELOW = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752,
)
NORMAL_FAR = 7.07106781186547
KOLMOGOROV_TERMS = 20


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 15 digits."""
    x = F.abs(z)

    def power_sum(coefs: tuple[float, ...]) -> Column:
        return reduce(lambda total, c: total * x + F.lit(c), coefs[1:], F.lit(coefs[0]))

    near = F.exp(-x * x / 2) * power_sum(NORMAL_ABOVE) / power_sum(NORMAL_BELOW)
    fraction = reduce(lambda below, k: x + F.lit(float(k)) / below, (4, 3, 2, 1), x + 0.65)
    far = F.exp(-x * x / 2) / fraction / 2.506628274631
    tail = F.when(x < NORMAL_FAR, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normality(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, mean, sd, ks, ks_p, ad, ad_p): each group against the normal law of its own mean and deviation.

    Kolmogorov-Smirnov with the limit law of a known normal (as the usual tools report it), and
    Anderson-Darling with the published p-value for fitted parameters. The empirical distribution
    comes from ranks in buckets, so a long group is spread over many tasks. Null values are left
    out; a group without spread has null results.
    """
    moments = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    placed = with_group_row(ranked_values(df, value, list(keys)), moments, list(keys))
    spread = F.when(F.col("sd") > 0, F.col("sd"))
    n, lo, hi = F.col("n"), F.col("_lo"), F.col("_hi")
    # far values keep a logarithm
    z = (F.col("_v") - F.col("mean")) / spread
    rows = placed.withColumn("_f", normal_cdf(z)).withColumn("_g", normal_cdf(-z))
    upper = F.col("_c") * (2 * n + 1) - hi * (hi + 1) + lo * (lo + 1)
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-300)))
    out = rows.groupBy(*keys, "n", "mean", "sd").agg(
        F.max(F.greatest(hi / n - F.col("_f"), F.col("_f") - lo / n)).alias("ks"),
        F.sum((hi * hi - lo * lo) * log("_f") + upper * log("_g")).alias("_sum"),
    )
    ad = F.when(F.col("sd") > 0, -n - F.col("_sum") / n)
    root = F.sqrt(n.cast("double"))
    reach = F.col("ks") * (root + 0.12 + 0.11 / root)
    terms = [(-1) ** (k - 1) * F.exp(-2 * k * k * reach * reach) for k in range(1, KOLMOGOROV_TERMS + 1)]
    ks_p = F.least(F.greatest(2 * reduce(lambda a, b: a + b, terms), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("ad", ad).withColumn("ks_p", F.when(F.col("sd") > 0, ks_p))
    return out.withColumn("ad_p", anderson_p(F.col("ad") * (1 + 0.75 / n + 2.25 / (n * n)))).select(
        *keys, "n", "mean", "sd", "ks", "ks_p", "ad", "ad_p"
    )


def anderson_p(a: Column) -> Column:
    """Fixed formula for the adjusted Anderson-Darling statistic of a normal with fitted parameters."""
    return (
        F.when(a >= 0.6, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a))
        .when(a >= 0.34, F.exp(0.9177 - 4.279 * a - 1.38 * a * a))
        .when(a >= 0.2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a))
        .otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
    )
