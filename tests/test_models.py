"""Trees, boosted trees and penalised regressions of many keys against Spark's fits of single ones."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tallyloom.operators import linear_models, regression, trees
from tallyloom.sources.models import load_models, model_path, save_models
from tallyloom.storage import scratch_path

FEATURES = ["a", "b", "c"]


def rows_of(keys, n, seed, steps=None):
    rng = np.random.default_rng(seed)
    out = []
    for k in keys:
        for _ in range(n):
            a = rng.normal() if steps is None else float(rng.integers(0, steps))
            b, c = float(rng.integers(0, 12)), float(rng.integers(0, steps or 300))
            y = 2 * a + (b > 5) * 3 + np.sin(c / 20) * (1 if k == keys[0] else -2) + 0.1 * rng.normal()
            out.append((len(out), k, a, b, c, 7.0, float(y)))
    return out


SHAPE = "id int, code string, a double, b double, c double, flat double, label double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_of("pq", 700, 1), SHAPE).cache()


def one(frame, code, features=FEATURES):
    return VectorAssembler(inputCols=features, outputCol="features").transform(frame.filter(F.col("code") == code))


def by_id(df, column="prediction"):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("rounds", [0, 10])
def test_trees_are_sparks(frame, rounds):
    models = trees.fit(frame, "code", "label", FEATURES, rounds)
    got = by_id(trees.predict(frame, models, "code", FEATURES))
    weight = {(r["code"], r["feature"]): r["weight"] for r in trees.importances(models, "code", FEATURES).collect()}
    for code in "pq":
        data = one(frame, code)
        model = (GBTRegressor(maxIter=rounds, seed=1) if rounds else DecisionTreeRegressor(seed=1)).fit(data)
        want = by_id(model.transform(data))
        assert {i: got[i] for i in want} == pytest.approx(want, abs=1e-9)
        # nodes of two rows can be split equally well by several features
        np.testing.assert_allclose([weight[code, f] for f in FEATURES], model.featureImportances.toArray(), atol=0.01)


@pytest.mark.parametrize("rounds", [0, 2])
def test_long_keys_get_the_same_trees(spark, monkeypatch, rounds):
    df = spark.createDataFrame(rows_of("pqr", 500, 2, steps=20), SHAPE).repartition(5)
    df = df.union(spark.createDataFrame([(9000 + i, "few", float(i), 1.0, 2.0, 7.0, float(i)) for i in range(20)], SHAPE))
    whole = by_id(trees.predict(df, trees.fit(df, "code", "label", FEATURES, rounds), "code", FEATURES))
    monkeypatch.setattr(trees, "HELD", 100)
    monkeypatch.setattr(trees, "ENTRIES", 64)
    spread = by_id(trees.predict(df, trees.fit(df, "code", "label", FEATURES, rounds), "code", FEATURES))
    assert spread == pytest.approx(whole, abs=1e-9) and len(whole) == 1520


def test_thousand_keys(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 1000).alias("code"), (F.col("id") % 17).cast("double").alias("a"),
        F.when(F.col("id") % 17 > 8, F.col("id") % 1000).otherwise(-1).cast("double").alias("label"),
    )
    models = trees.fit(df, "code", "label", ["a"])
    assert models.count() == 1000
    off = trees.predict(df, models, "code", ["a"]).filter(F.abs(F.col("prediction") - F.col("label")) > 1e-9)
    assert off.count() == 0
    grid = linear_models.grid(df.withColumn("id", F.monotonically_increasing_id()), "code", "label", ["a"], ["id"])
    assert grid.count() == 12_000


def test_odd_rows_and_keys(spark):
    rows = [(1, "one", 1.0, 2.0, 3.0, 7.0, 4.0), (2, "same", 1.0, 1.0, 1.0, 7.0, 5.0), (3, "same", 1.0, 1.0, 1.0, 7.0, 5.0)]
    bad = [(4, None, 1.0, 1.0, 1.0, 7.0, 1.0), (5, "same", None, 1.0, 1.0, 7.0, 1.0), (6, "same", float("nan"), 1.0, 1.0, 7.0, 9.0), (7, "gone", 1.0, 1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(rows + bad, SHAPE)
    models = trees.fit(df, "code", "label", FEATURES, 3)
    got = by_id(trees.predict(df, models, "code", FEATURES))
    assert {i: got[i] for i in (1, 2, 3)} == {1: 4.0, 2: 5.0, 3: 5.0} and got[5] is None and 7 not in got
    assert {r["weight"] for r in trees.importances(models, "code", FEATURES).collect()} == {0.0}
    assert trees.fit(df.limit(0), "code", "label", FEATURES).count() == 0


def test_grid_is_sparks(frame):
    features = [*FEATURES, "flat"]
    held = regression.in_training(["id"], 80, 54321)
    for r in linear_models.grid(frame, "code", "label", features, ["id"]).filter("code = 'q'").collect():
        data = one(frame, r["code"], features)
        own = LinearRegression(
            regParam=r["reg_param"], fitIntercept=r["intercept"], elasticNetParam=r["elastic_net"], maxIter=2000, tol=1e-14
        )
        model = own.fit(data)
        np.testing.assert_allclose(r["coef"], [model.intercept, *model.coefficients], atol=1e-6)
        rmse = own.fit(data.filter(held)).evaluate(data.filter(~held)).rootMeanSquaredError
        assert r["rmse"] == pytest.approx(rmse, abs=1e-6)


def test_best_setting_predicts(frame):
    grid = linear_models.grid(frame, "code", "label", FEATURES, ["id"])
    best = {r["code"]: r["coef"] for r in linear_models.best(grid, "code").collect()}
    for code in "pq":
        least = grid.filter(F.col("code") == code).orderBy("rmse").first()
        assert best[code] == least["coef"]
    got = linear_models.predict(frame, linear_models.best(grid, "code"), "code", FEATURES).first()
    c = best[got["code"]]
    assert got["prediction"] == pytest.approx(c[0] + c[1] * got["a"] + c[2] * got["b"] + c[3] * got["c"])


def test_summary_and_training_are_sparks(frame):
    terms = {(r["code"], r["term"]): r for r in linear_models.summary(frame, "code", "label", FEATURES).collect()}
    metric = {(r["code"], r["metric"]): r["value"] for r in linear_models.training(frame, "code", "label", FEATURES).collect()}
    for code in "pq":
        s = LinearRegression(solver="normal").fit(one(frame, code)).summary
        for i, term in enumerate([*FEATURES, "intercept"]):
            own = terms[code, term]
            assert own["se"] == pytest.approx(s.coefficientStandardErrors[i], rel=1e-6)
            assert own["p_value"] == pytest.approx(s.pValues[i], abs=1e-6)
        want = {"r2": s.r2, "rmse": s.rootMeanSquaredError, "mse": s.meanSquaredError, "mae": s.meanAbsoluteError, "explained_variance": s.explainedVariance}
        assert {m: metric[code, m] for m in want} == pytest.approx(want, rel=1e-6)


def test_tables_of_models_by_name(frame, spark):
    root = scratch_path(spark, "m")
    for family in regression.FAMILIES:
        models = regression.fit(frame, "code", "label", FEATURES, family, ["id"])
        save_models(models, root, family, "code")
        again = load_models(spark, root, family, models.schema)
        want, got = (by_id(regression.predict(frame, m, "code", FEATURES)) for m in (models, again))
        assert want == got and len(want) == 1400
        assert spark.read.parquet(model_path(root, family, code="p")).count() == 1


@pytest.mark.parametrize("mix", [0.5, 1.0])
@pytest.mark.parametrize("intercept", [False, True])
def test_terms_alike_need_no_more_sweeps(monkeypatch, intercept, mix):
    # counts of many events are nearly constant; sweeps over single terms take ten thousands of rounds there
    monkeypatch.setattr(linear_models, "SWEEPS", 20)
    rng = np.random.default_rng(5)
    x = np.column_stack([50 + rng.normal(0, 0.2, 700), rng.poisson(1200, (700, 7))])
    y = x @ rng.normal(0, 0.1, 8) + rng.normal(0, 1, 700)
    rows = np.column_stack([np.ones(700), x, y])
    coef = linear_models.elastic_net(rows.T @ rows, 0.1, intercept, mix)
    pull = (x / x.std(0)).T @ (y - coef[0] - x @ coef[1:]) / 700 / y.std()
    scaled = coef[1:] * x.std(0) / y.std()
    pull -= 0.1 * (1 - mix) / y.std() * scaled
    flat = 0.1 * mix / y.std()
    assert (coef[0] != 0) == intercept and np.any(scaled != 0)
    assert np.allclose(pull[scaled != 0], flat * np.sign(scaled[scaled != 0]), atol=1e-8)
    assert np.all(np.abs(pull) <= flat + 1e-8)
