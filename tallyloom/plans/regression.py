"""Hourly occupancy explained by area counts and temperature."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import linear_models, regression, stats, trees
from tallyloom.plans.registry import query, steady
from tallyloom.plans.views import Tables, area_hourly, event_rows, occupancy_hourly, weather_hourly, with_views
from tallyloom.sources.models import load_model, load_models, save_model, save_models
from tallyloom.storage import scratch_path, written

AREAS = [1, 2, 3, 4, 5, 6, 7]
FEATURES = ["temperature", *[f"count_{a}" for a in AREAS]]
MINUTE = "yyyy-MM-dd HH:mm"


def wide(t: Tables):
    return regression.wide_counts(area_hourly(t), "ts", "cluster", "count", AREAS)


def frame(t: Tables):
    """One row per code and hour: label, temperature and seven area counts."""
    return regression.feature_frame(occupancy_hourly(t), wide(t), weather_hourly(t))


WIDE = "wide AS (SELECT ts, " + ", ".join(
    f"sum(cnt) FILTER (cluster = {a}) AS count_{a}" for a in AREAS
) + " FROM area_hourly GROUP BY 1 HAVING " + " AND ".join(f"count(*) FILTER (cluster = {a}) > 0" for a in AREAS) + """),
frame AS (SELECT o.code, w.*, o.label, h.temperature FROM occupancy_hourly o JOIN wide w ON w.ts = o.ts
  JOIN weather_hourly h ON h.ts = o.ts)"""
VIEWS = "occupancy_hourly area_hourly weather_hourly"
COUNTS = ", ".join(f"count_{a}" for a in AREAS)


@query("wide_feature_join", with_views(VIEWS, f"""
SELECT strftime(w.ts, '%Y-%m-%d %H:%M') AS hour, CAST(round(TRY_CAST(temperature AS DECIMAL(28,9)), 6) AS DOUBLE) AS temperature, {COUNTS}
FROM wide w JOIN weather_hourly h ON h.ts = w.ts""", WIDE))
def wide_feature_join(t: Tables):
    """Seven area counts beside the temperature: one pivot and one join."""
    w = wide(t).join(weather_hourly(t), "ts")
    return w.select(
        F.date_format("ts", MINUTE).alias("hour"), steady("temperature", 6).alias("temperature"), *FEATURES[1:]
    )


@query("reg_frame", with_views(VIEWS, f"""
SELECT code, strftime(ts, '%Y-%m-%d %H:%M') AS hour, CAST(round(TRY_CAST(label AS DECIMAL(28,9)), 6) AS DOUBLE) AS label, CAST(round(TRY_CAST(temperature AS DECIMAL(28,9)), 6) AS DOUBLE) AS temperature, {COUNTS}
FROM frame""", WIDE))
def reg_frame(t: Tables):
    """The frame the regressors see."""
    return frame(t).select(
        "code", F.date_format("ts", MINUTE).alias("hour"), steady("label", 6).alias("label"),
        steady("temperature", 6).alias("temperature"), *FEATURES[1:],
    )


PAIRS = [("label", f) for f in FEATURES]


@query("reg_corr", with_views(VIEWS, " UNION ALL ".join(
    f"SELECT code, '{a}' AS a, '{b}' AS b, CAST(round(TRY_CAST(corr({a}, {b}) AS DECIMAL(28,9)), 6) AS DOUBLE) AS r FROM frame GROUP BY 1"
    for i, a in enumerate(["label", *FEATURES]) for b in ["label", *FEATURES][i + 1:]), WIDE))
def reg_corr(t: Tables):
    """All correlations of label and features, per code, in one aggregation."""
    r = stats.pairwise_corr(frame(t), ["label", *FEATURES], "code")
    return r.withColumn("r", steady("r", 6))


@query("reg_split")
def reg_split(t: Tables):
    """Rows per code in training and held out."""
    mark = regression.in_training(["code", "ts"]).alias("train")
    return frame(t).select("code", mark).groupBy("code", "train").agg(F.count(F.lit(1)).alias("n"))


ROW = ["code", "ts"]


def training(t: Tables):
    """The frame of all codes and the split, written once for the fits."""
    return written(frame(t).withColumn("_train", regression.in_training(ROW)), "frame")


def held_out(t: Tables, family: str):
    """Predictions and residuals of the rows kept from training, every code by its own model."""
    data = training(t)
    scored = regression.predictions(
        data.filter("_train"), data.filter("NOT _train"), "code", "label", FEATURES, [family], ROW
    )
    return scored.select(
        "code", F.date_format("ts", MINUTE).alias("hour"), "label", "prediction", (F.col("prediction") - F.col("label")).alias("res")
    )


@query("linreg_grid")
def linreg_grid(t: Tables):
    """Validation error of twelve linear settings for every code, all from one pass over the rows."""
    train = frame(t).filter(regression.in_training(ROW))
    return linear_models.grid(train, "code", "label", FEATURES, ROW).drop("coef")


@query("linreg_summary")
def linreg_summary(t: Tables):
    """Coefficients with errors and p-values of a plain linear fit of every code."""
    return linear_models.summary(frame(t), "code", "label", FEATURES)


@query("linreg_training")
def linreg_training(t: Tables):
    """Training metrics of a plain linear fit of every code."""
    return linear_models.training(frame(t), "code", "label", FEATURES)


@query("linreg_reg")
def linreg_reg(t: Tables):
    """Held-out predictions and residuals of the best linear setting of every code."""
    return held_out(t, "linear")


@query("linreg_simple", with_views("event_rows", """
SELECT CAST(round(TRY_CAST(regr_slope(value, k) AS DECIMAL(28,9)), 6) AS DOUBLE) AS slope, CAST(round(TRY_CAST(regr_intercept(value, k) AS DECIMAL(28,9)), 6) AS DOUBLE) AS intercept,
  CAST(round(TRY_CAST(regr_r2(value, k) AS DECIMAL(28,9)), 6) AS DOUBLE) AS r2, count(*) AS n FROM event_rows"""))
def linreg_simple(t: Tables):
    """One feature over all events: slope, intercept and R2."""
    data = regression.assembled(event_rows(t).select(F.col("value").alias("label"), F.col("k").cast("double").alias("k")), ["k"])
    model = LinearRegression(solver="normal").fit(data)
    scored = model.transform(data)
    errors = stats.fit_errors(scored, "label", "prediction")
    return errors.select(
        steady(F.lit(float(model.coefficients[0])), 6).alias("slope"),
        steady(F.lit(float(model.intercept)), 6).alias("intercept"),
        steady("r2", 6).alias("r2"),
        "n",
    )


@query("linreg_per_key", with_views("event_rows", """
SELECT series, CAST(round(TRY_CAST(regr_slope(value, k) AS DECIMAL(28,9)), 6) AS DOUBLE) AS coef, count(*) AS nobs, CAST(round(TRY_CAST(regr_r2(value, k) AS DECIMAL(28,9)), 6) AS DOUBLE) AS r2,
  CAST(round(TRY_CAST(sqrt((regr_syy(value, k) - regr_sxy(value, k) ^ 2 / regr_sxx(value, k)) / (count(*) - 2) / regr_sxx(value, k)) AS DECIMAL(28,9)), 6) AS DOUBLE) AS se
FROM event_rows GROUP BY 1"""))
def linreg_per_key(t: Tables):
    """The same regression for every event type in one job."""
    fits = regression.linear_per_key(event_rows(t), "series", "value", ["k"]).filter("term = 'k'")
    return fits.select("series", "nobs", *[steady(c, 6).alias(c) for c in ("coef", "se", "r2")])


@query("linreg_features_per_key")
def linreg_features_per_key(t: Tables):
    """Temperature and seven area counts, for every code in one job."""
    return regression.linear_per_key(frame(t), "code", "label", FEATURES)


@query("tree_reg")
def tree_reg(t: Tables):
    """Held-out predictions and residuals of a decision tree for every code."""
    return held_out(t, "tree")


@query("gbt_reg")
def gbt_reg(t: Tables):
    """Held-out predictions and residuals of boosted trees for every code."""
    return held_out(t, "gbt")


@query("feature_importance")
def feature_importance(t: Tables):
    """Weights of the features in the tree and boosted models of every code."""
    data = training(t).filter("_train")
    each = [
        trees.importances(regression.fit(data, "code", "label", FEATURES, f, ROW), "code", FEATURES).withColumn("family", F.lit(f))
        for f in ("tree", "gbt")
    ]
    return each[0].unionByName(each[1])


@query("model_compare")
def model_compare(t: Tables):
    """Three model families for each code, by held-out error."""
    return regression.compare(frame(t), "code", FEATURES, regression.FAMILIES, ROW)


@query("model_roundtrip")
def model_roundtrip(t: Tables):
    """Every model of every code, and a pipeline over all codes, saved, loaded and applied again."""
    data = training(t).drop("_train")
    root = scratch_path(t.spark, "models")
    first, again = F.col("prediction").alias("first"), F.col("prediction").alias("again")
    each = []
    for family in regression.FAMILIES:
        models = written(regression.fit(data, "code", "label", FEATURES, family, ROW), "models")
        save_models(models, root, family, "code")
        loaded = load_models(t.spark, root, family, models.schema)
        own, other = (regression.predict(data, m, "code", FEATURES) for m in (models, loaded))
        pair = own.select("code", "ts", first).join(other.select("code", "ts", again), ["code", "ts"])
        each.append(pair.withColumn("family", F.lit(family)))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")
    fitted = Pipeline(stages=[vector, LinearRegression(solver="normal")]).fit(data)
    save_model(fitted, root, "pipeline", codes="all")
    loaded = load_model(root, "pipeline", codes="all")
    pair = fitted.transform(data).select("code", "ts", first).join(loaded.transform(data).select("code", "ts", again), ["code", "ts"])
    each.append(pair.withColumn("family", F.lit("pipeline")))
    return reduce(DataFrame.unionByName, each).groupBy("code", "family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("first").eqNullSafe(F.col("again"))).alias("unequal")
    )
