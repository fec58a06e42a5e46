"""Grouped counts, shares, ranks, bands and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key; rows with a null key are left out."""
    return df.na.drop("any", subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_pivot(df: DataFrame, key: str, column: str, values: list[str], names: list[str]) -> DataFrame:
    """One pass, one row per key, one count column per listed value."""
    cells = [F.count_if(F.col(column) == v).alias(n) for v, n in zip(values, names)]
    return df.groupBy(key).agg(*cells)


def categories_per_group(df: DataFrame, group: str, category: str, without: list[str], name: str) -> DataFrame:
    """How many categories occur in each group, not counting the listed ones."""
    kept = df.filter(~F.col(category).isin(without)) if without else df
    return kept.groupBy(group).agg(F.count_distinct(category).alias(name))


def top_share_in_group(df: DataFrame, group: str, category: str, k: int) -> DataFrame:
    """The ``k`` most frequent categories of each group with their percentage.

    The window runs over counted (group, category) rows, never over input rows.
    """
    counted = count_by(df, group, category)
    totals = counted.groupBy(group).agg(F.sum("n").alias("total"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(category))
    best = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(totals, group).select(
        group, category, "n", "rank", (F.col("n") * 100.0 / F.col("total")).alias("percent")
    )


def share_of_total(df: DataFrame, category: str) -> DataFrame:
    """Count and fraction of each category."""
    counted = count_by(df, category)
    total = counted.agg(F.sum("n")).scalar()
    return counted.select(category, "n", (F.col("n") / total).alias("share"))


def exploded_counts(df: DataFrame, items: str, *keys: str, out: str = "item") -> DataFrame:
    """Non-blank array elements counted, per key if keys are given."""
    flat = df.select(*keys, F.explode(items).alias(out)).filter(F.length(out) > 0)
    return flat.groupBy(*keys, out).agg(F.count(F.lit(1)).alias("n"))


def top_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def size_histogram(df: DataFrame, items: str, *keys: str, cap: int = 5) -> DataFrame:
    """Rows by number of tags: 0, 1 .. cap, and one bucket for more.

    ``share`` is the part of all rows, ``share_tagged`` the part of tagged rows.
    """
    size = F.size(F.filter(items, lambda t: F.length(t) > 0))
    bucket = F.least(size, F.lit(cap + 1)).alias("bucket")
    counted = df.select(*keys, bucket).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)
    tagged = F.when(F.col("bucket") > 0, F.col("n"))
    return counted.select(
        *keys,
        "bucket",
        "n",
        (F.col("n") / F.sum("n").over(whole)).alias("share"),
        (tagged / F.sum(tagged).over(whole)).alias("share_tagged"),
    )


def tag_replication(df: DataFrame, category: str, items: str) -> DataFrame:
    """Tags in all, distinct tags, tags per row and uses per tag; overall and per category."""
    per_tag = exploded_counts(df, items, category)
    rows = df.groupBy(category).agg(F.count(F.lit(1)).alias("posts"))
    by_cat = per_tag.groupBy(category).agg(
        F.sum("n").alias("tags"), F.count(F.lit(1)).alias("distinct_tags")
    )
    by_cat = rows.join(by_cat, category, "left").na.fill(0, ["tags", "distinct_tags"])
    every = per_tag.groupBy("item").agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("tags"), F.count(F.lit(1)).alias("distinct_tags")
    )
    all_tags = every.select("tags").scalar()
    all_distinct = every.select("distinct_tags").scalar()
    posts = rows.agg(F.sum("posts")).scalar()
    every = every.select(F.lit("all").alias(category), posts.alias("posts"), "tags", "distinct_tags")
    return every.unionByName(by_cat).select(
        category,
        "posts",
        "tags",
        "distinct_tags",
        (F.col("tags") / all_tags).alias("share_tags"),
        (F.col("distinct_tags") / all_distinct).alias("share_distinct"),
        (F.col("tags") / F.col("posts")).alias("tags_per_post"),
        (F.col("tags") / F.col("distinct_tags")).alias("uses_per_tag"),
    )


def keys_in_band(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Keys whose row count lies strictly between the bounds."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") > low) & (F.col("n") < high))


def rows_of_band(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows whose key lies in the band, by semi join."""
    return df.join(keys_in_band(df, key, low, high), key, "left_semi")


def rows_of_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of a list of keys; Spark broadcasts the list when it turns out short."""
    return df.join(wanted.select(key), key, "left_semi")


def rows_at_group_max(df: DataFrame, group: str, value: str) -> DataFrame:
    """All rows that reach the greatest value of their group, ties kept."""
    best = df.groupBy(group).agg(F.max(value).alias(value))
    return df.join(best, [group, value], "left_semi")


def missing_categories(df: DataFrame, group: str, category: str, groups: Column) -> DataFrame:
    """(group, category) pairs never seen, for each category of the table.

    ``groups`` is the array of all group values, such as the twelve months. The
    seen groups of a category are a set no longer than that array, so no product
    of the two lists is built.
    """
    seen = df.groupBy(category).agg(F.collect_set(group).alias("seen"))
    return seen.select(F.explode(F.array_except(groups, F.col("seen"))).alias(group), category)


def exclusive_terms(df: DataFrame, group: str, *terms: str) -> DataFrame:
    """Terms (or combinations of several columns) found in exactly one group, with that group."""
    spread = df.groupBy(*terms).agg(F.min(group).alias(group), F.max(group).alias("_last"))
    return spread.filter(F.col(group) == F.col("_last")).drop("_last")


def common_terms(df: DataFrame, group: str, term: str) -> DataFrame:
    """Terms found in every group."""
    pairs = df.select(group, term).distinct()
    n_groups = pairs.agg(F.count_distinct(group)).scalar()
    spread = pairs.groupBy(term).agg(F.count(F.lit(1)).alias("_in"))
    return spread.filter(F.col("_in") == n_groups).select(term)


def terms_not_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key rows of the left frame that the right frame lacks; null keys never match."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two labellings meet."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def enrich(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Inner join with one enrichment row per key; repeated enrichment rows are merged first."""
    return df.join(extra.dropDuplicates([key]), key, "inner")
