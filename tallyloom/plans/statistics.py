"""Engagement statistics, correlations, quantiles, bounds and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import counts, stats
from tallyloom.plans.registry import query, steady
from tallyloom.plans.views import Tables, event_rows, post_engagement, posts, with_views


def rounded(df, *columns, places: int = 6):
    return df.withColumns({c: steady(c, places) for c in columns})


@query("engagement_by_month", with_views("post_engagement", """
SELECT month, CAST(sum(reshares) AS BIGINT) AS total, CAST(round(TRY_CAST(avg(reshares) AS DECIMAL(28,9)), 6) AS DOUBLE) AS mean,
  CAST(round(TRY_CAST(stddev_samp(reshares) AS DECIMAL(28,9)), 6) AS DOUBLE) AS sd, max(reshares) AS max, min(reshares) AS min
FROM post_engagement GROUP BY 1"""))
def engagement_by_month(t: Tables):
    return rounded(stats.engagement(post_engagement(t), "month", "reshares"), "mean", "sd")


@query("pairwise_corr", with_views("post_engagement", """
SELECT language, a, b, CAST(round(TRY_CAST(r AS DECIMAL(28,9)), 6) AS DOUBLE) AS r FROM (
  SELECT language, 'reshares' AS a, 'num_replies' AS b, corr(reshares, num_replies) AS r FROM post_engagement GROUP BY 1
  UNION ALL SELECT language, 'reshares', 'likes', corr(reshares, CAST(likes AS DOUBLE)) FROM post_engagement GROUP BY 1
  UNION ALL SELECT language, 'num_replies', 'likes', corr(num_replies, CAST(likes AS DOUBLE))
  FROM post_engagement GROUP BY 1)"""))
def pairwise_corr(t: Tables):
    """Correlation of reshares, replies and likes, per language, in one aggregation."""
    p = post_engagement(t).withColumn("likes", F.col("likes").cast("double"))
    return rounded(stats.pairwise_corr(p, ["reshares", "num_replies", "likes"], "language"), "r")


@query("describe_table", with_views("event_rows", """
SELECT 'value' AS "column", count(value) AS n, CAST(round(TRY_CAST(avg(value) AS DECIMAL(28,9)), 6) AS DOUBLE) AS mean, CAST(round(TRY_CAST(stddev_samp(value) AS DECIMAL(28,9)), 6) AS DOUBLE) AS sd,
  min(value) AS min, max(value) AS max FROM event_rows
UNION ALL SELECT 'k', count(k), CAST(round(TRY_CAST(avg(k) AS DECIMAL(28,9)), 6) AS DOUBLE), CAST(round(TRY_CAST(stddev_samp(k) AS DECIMAL(28,9)), 6) AS DOUBLE), CAST(min(k) AS DOUBLE), CAST(max(k) AS DOUBLE)
FROM event_rows"""))
def describe_table(t: Tables):
    return rounded(stats.describe(event_rows(t), ["value", "k"]), "mean", "sd")


@query("boxplot_stats", with_views("post_engagement", """
SELECT month, n, q1, median, q3, min(v) FILTER (v BETWEEN lo AND hi) AS whisker_low,
  max(v) FILTER (v BETWEEN lo AND hi) AS whisker_high, min(v) AS min, max(v) AS max,
  CAST(count(*) FILTER (NOT v BETWEEN lo AND hi) AS BIGINT) AS outliers
FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT p.month, CAST(p.reshares AS DOUBLE) AS v, q.* EXCLUDE (month) FROM post_engagement p JOIN (
    SELECT month, count(*) AS n, quantile_cont(CAST(reshares AS DOUBLE), 0.25) AS q1,
      quantile_cont(CAST(reshares AS DOUBLE), 0.5) AS median, quantile_cont(CAST(reshares AS DOUBLE), 0.75) AS q3
    FROM post_engagement GROUP BY 1) q USING (month)))
GROUP BY month, n, q1, median, q3"""))
def boxplot_stats(t: Tables):
    """Box-plot numbers of reshares per month, with exact quartiles."""
    return stats.boxplot(post_engagement(t), "reshares", ["month"])


@query("boxplot_likes", with_views("posts", """
SELECT n, CAST(round(TRY_CAST(q1 AS DECIMAL(28,9)), 4) AS DOUBLE) AS q1, CAST(round(TRY_CAST(median AS DECIMAL(28,9)), 4) AS DOUBLE) AS median, CAST(round(TRY_CAST(q3 AS DECIMAL(28,9)), 4) AS DOUBLE) AS q3,
  min(v) FILTER (v BETWEEN lo AND hi) AS whisker_low, max(v) FILTER (v BETWEEN lo AND hi) AS whisker_high,
  min(v) AS min, max(v) AS max, CAST(count(*) FILTER (NOT v BETWEEN lo AND hi) AS BIGINT) AS outliers
FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
  (SELECT CAST(likes AS DOUBLE) AS v FROM posts) CROSS JOIN (
    SELECT count(*) AS n, quantile_cont(CAST(likes AS DOUBLE), 0.25) AS q1,
      quantile_cont(CAST(likes AS DOUBLE), 0.5) AS median, quantile_cont(CAST(likes AS DOUBLE), 0.75) AS q3 FROM posts))
GROUP BY n, q1, median, q3"""))
def boxplot_likes(t: Tables):
    """One box over all posts: mostly distinct values and a single group."""
    return rounded(stats.boxplot(posts(t), "likes", []), "q1", "median", "q3", places=4)


@query("outlier_bounds", with_views("event_rows", """
SELECT series, CAST(round(TRY_CAST(mean AS DECIMAL(28,9)), 6) AS DOUBLE) AS mean, CAST(round(TRY_CAST(sd AS DECIMAL(28,9)), 6) AS DOUBLE) AS sd, CAST(round(TRY_CAST(mean - 2 * sd AS DECIMAL(28,9)), 6) AS DOUBLE) AS low, CAST(round(TRY_CAST(mean + 2 * sd AS DECIMAL(28,9)), 6) AS DOUBLE) AS high
FROM (SELECT series, avg(value) AS mean, stddev_samp(value) AS sd FROM event_rows GROUP BY 1)"""))
def outlier_bounds(t: Tables):
    return rounded(stats.mean_bounds(event_rows(t), "value", "series"), "mean", "sd", "low", "high")


@query("daily_outliers", with_views("posts", """
SELECT day, n, tail FROM (
  SELECT day, n, CASE WHEN n > m + 2 * s THEN 'high' WHEN n < m - 2 * s THEN 'low' END AS tail
  FROM (SELECT day, count(*) AS n FROM posts GROUP BY 1),
       (SELECT avg(n) AS m, stddev_samp(n) AS s FROM (SELECT count(*) AS n FROM posts GROUP BY CAST(ts AS DATE))))
WHERE tail IS NOT NULL"""))
def daily_outliers(t: Tables):
    """Days whose number of posts lies beyond two deviations; the bounds are computed."""
    return stats.beyond_bounds(counts.count_by(posts(t), "day"), "n").select("day", "n", "tail")


@query("daily_outliers_lang", with_views("posts", """
SELECT language, day, n FROM (
  SELECT language, day, n, avg(n) OVER w + 2 * stddev_samp(n) OVER w AS high
  FROM (SELECT language, day, count(*) AS n FROM posts GROUP BY 1, 2) WINDOW w AS (PARTITION BY language))
WHERE n > high"""))
def daily_outliers_lang(t: Tables):
    """The same per language: all languages in one query."""
    daily = counts.count_by(posts(t), "language", "day")
    return stats.beyond_bounds(daily, "n", "language").filter("tail = 'high'").select("language", "day", "n")


@query("score_tail_share", with_views("event_rows", """
SELECT count(*) AS n, CAST(round(TRY_CAST(avg(CASE WHEN s < -0.97 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS very_negative,
  CAST(round(TRY_CAST(avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS negative,
  CAST(round(TRY_CAST(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS positive,
  CAST(round(TRY_CAST(avg(CASE WHEN s > 0.97 THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,9)), 6) AS DOUBLE) AS very_positive
FROM (SELECT (k - 50) / 50.0 AS s FROM event_rows)"""))
def score_tail_share(t: Tables):
    """Parts of rows in the tails of a score in [-1, 1)."""
    scored = event_rows(t).withColumn("score", (F.col("k") - 50) / F.lit(50.0))
    return rounded(
        stats.tail_shares(scored, "score", 0.97), "very_negative", "negative", "positive", "very_positive"
    )


@query("daily_score_corr", with_views("event_rows", """
SELECT CAST(round(TRY_CAST(corr(v, k) AS DECIMAL(28,9)), 6) AS DOUBLE) AS r_value_k, CAST(round(TRY_CAST(corr(v, n) AS DECIMAL(28,9)), 6) AS DOUBLE) AS r_value_n FROM (
  SELECT CAST(ts AS DATE) AS day, avg(value) AS v, avg(k) AS k, count(*) AS n FROM event_rows GROUP BY 1)"""))
def daily_score_corr(t: Tables):
    """Daily means of two measures and the daily count, then their correlations."""
    daily = event_rows(t).groupBy(F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("v"), F.avg("k").alias("k"), F.count(F.lit(1)).alias("n")
    )
    return daily.agg(steady(F.corr("v", "k"), 6).alias("r_value_k"), steady(F.corr("v", "n"), 6).alias("r_value_n"))


@query("regression_eval", """
WITH p AS (SELECT l_returnflag AS key, l_extendedprice AS label, l_quantity * 1000 AS prediction FROM lineitem)
SELECT key, count(*) AS n, CAST(round(TRY_CAST(sqrt(avg((label - prediction) ^ 2)) AS DECIMAL(28,9)), 4) AS DOUBLE) AS rmse,
  CAST(round(TRY_CAST(avg((label - prediction) ^ 2) AS DECIMAL(28,9)), 2) AS DOUBLE) AS mse, CAST(round(TRY_CAST(avg(abs(label - prediction)) AS DECIMAL(28,9)), 4) AS DOUBLE) AS mae,
  CAST(round(TRY_CAST(1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*)) AS DECIMAL(28,9)), 6) AS DOUBLE) AS r2 FROM p GROUP BY 1""")
def regression_eval(t: Tables):
    """Four error measures of a given prediction column, per key, in one aggregation."""
    p = t.lineitem.select(
        F.col("l_returnflag").alias("key"),
        F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1000).alias("prediction"),
    )
    e = stats.fit_errors(p, "label", "prediction", "key")
    return e.select(
        "key", "n", steady("rmse", 4).alias("rmse"), steady("mse", 2).alias("mse"), steady("mae", 4).alias("mae"),
        steady("r2", 6).alias("r2"),
    )
