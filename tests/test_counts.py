"""Counts, quantiles, bounds and set operations against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cleaning, counts, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_share_ties(spark):
    df = spark.createDataFrame([(1, c) for c in "bbaac"] + [(2, "z")], "month int, lang string")
    got = rows(counts.top_share_in_group(df, "month", "lang", 2))
    assert got == [(1, "a", 2, 1, 40.0), (1, "b", 2, 2, 40.0), (2, "z", 1, 1, 100.0)]


def test_missing_categories(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b")], "month int, lang string")
    got = rows(counts.missing_categories(df, "month", "lang", F.sequence(F.lit(1), F.lit(3))))
    assert got == [(1, "b"), (2, "b"), (3, "a")]


def test_exclusive_and_common(spark):
    df = spark.createDataFrame([(0, "x"), (0, "x"), (1, "y"), (0, "y"), (1, "z")], "topic int, term string")
    assert rows(counts.exclusive_terms(df, "topic", "term")) == [("x", 0), ("z", 1)]
    assert rows(counts.common_terms(df, "topic", "term")) == [("y",)]


def test_terms_not_in(spark):
    a = spark.createDataFrame([(0, "x"), (1, "x"), (0, "x")], "t int, e string")
    b = spark.createDataFrame([(1, "x"), (0, None)], "t int, e string")
    assert rows(counts.terms_not_in(a, b, ["t", "e"])) == [(0, "x")]


def test_histogram(spark):
    data = [([],), ([""],), (["a"],), (["a", "b"],), (list("abcdef"),), (list("abcdefg"),)]
    got = rows(counts.size_histogram(spark.createDataFrame(data, "items array<string>"), "items"))
    assert [(b, n) for b, n, _, _ in got] == [(0, 2), (1, 1), (2, 1), (6, 2)]
    assert got[0][2] == pytest.approx(1 / 3) and got[0][3] is None and got[3][3] == 0.5


def test_enrich_keeps_row_count(spark):
    a = spark.createDataFrame([(1, "p"), (2, "q")], "id int, v string")
    b = spark.createDataFrame([(1, "en"), (1, "en"), (2, "it")], "id int, lang string")
    assert counts.enrich(a, b, "id").count() == 2


def test_band_is_exclusive(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbcccc"], "k string")
    assert rows(counts.keys_in_band(df, "k", 2, 4)) == [("b", 3)]
    assert counts.rows_of_band(df, "k", 2, 4).count() == 3


def test_group_max_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, 1)], "m int, v int")
    assert counts.rows_at_group_max(df, "m", "v").count() == 3


@pytest.mark.parametrize("splits", [4, 64])
def test_exact_quantiles(spark, splits):
    rng = np.random.default_rng(3)
    hot = np.r_[np.full(5000, 7.0), rng.lognormal(size=4000)]
    data = {"hot": hot, "odd": rng.normal(size=1001), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("odd", None)], "k string, v double")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p0": 0.0, "p100": 1.0}
    got = {r["k"]: r for r in stats.exact_quantiles(df, "v", ["k"], probs, splits).collect()}
    for k, vs in data.items():
        assert got[k]["n"] == len(vs)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12), (k, name)


def test_boxplot(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    r = stats.boxplot(df, "v", []).first()
    assert (r["whisker_low"], r["whisker_high"], r["max"], r["outliers"]) == (1.0, 5.0, 100.0, 1)


def test_bounds(spark):
    vs = [1.0] * 20 + [50.0]
    df = spark.createDataFrame([("a", v) for v in vs], "k string, v double")
    r = stats.mean_bounds(df, "v", "k").first()
    assert r["high"] == pytest.approx(np.mean(vs) + 2 * np.std(vs, ddof=1))
    assert [x["tail"] for x in stats.beyond_bounds(df, "v").collect()] == ["high"]


def test_fit_errors(spark):
    a, p = np.array([1.0, 2, 3, 5]), np.array([1.5, 2, 2, 6])
    df = spark.createDataFrame(list(zip(a.tolist(), p.tolist())) + [(1.0, None)], "a double, p double")
    r = stats.fit_errors(df, "a", "p").first()
    assert (r["n"], r["rss"]) == (4, 2.25)
    assert r["r2"] == pytest.approx(1 - 2.25 / np.sum((a - a.mean()) ** 2))


def test_jarque_bera(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(
        [("n", float(v)) for v in rng.normal(size=3000)] + [("e", float(v)) for v in rng.exponential(size=3000)], "k string, v double"
    )
    got = {r["k"]: r["p_value"] for r in stats.jarque_bera(df, "v", "k").collect()}
    assert got["n"] > 0.01 and got["e"] < 1e-6


def test_drop_nulls_and_slice(spark):
    df = spark.createDataFrame([("a", "2020-01-01"), (None, "2020-01-02"), ("c", "2020-01-03")], "v string, d string")
    assert cleaning.drop_nulls(df).count() == 2
    days = df.withColumn("d", F.col("d").cast("date"))
    assert cleaning.between(days, "d", "2020-01-01", "2020-01-02").count() == 2


def test_normality_tests(spark, monkeypatch):
    """Against the plain formulas, with ties, far values, a constant and a long group in buckets."""
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(5, 2, 900), "flat": rng.random(400), "ties": rng.integers(0, 5, 300).astype(float), "far": np.append(rng.normal(size=50), 1e6)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("same", 1.0)] * 4 + [("normal", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in stats.normality(df, "v", "k").collect()}
    for k, v in groups.items():
        x = np.sort(v)
        n, z = len(x), (x - x.mean()) / x.std(ddof=1)
        f = np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in z])
        g = np.array([0.5 * math.erfc(t / math.sqrt(2)) for t in z])
        i = np.arange(1, n + 1)
        assert got[k]["n"] == n
        assert got[k]["ks"] == pytest.approx(max((i / n - f).max(), (f - (i - 1) / n).max()), abs=1e-9)
        ad = -n - ((2 * i - 1) * (np.log(np.maximum(f, 1e-300)) + np.log(np.maximum(g[::-1], 1e-300)))).mean()
        assert got[k]["ad"] == pytest.approx(ad, rel=1e-8, abs=1e-8)
    assert got["normal"]["ad_p"] > 0.05 and got["normal"]["ks_p"] > 0.05
    assert got["flat"]["ad_p"] < 0.01 and got["ties"]["ks_p"] < 0.01
    assert got["same"]["ks"] is None and got["same"]["ad_p"] is None
