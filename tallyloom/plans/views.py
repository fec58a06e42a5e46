"""The analyses' inputs, built from the test tables.

Each function here has a text twin in :data:`SQL`, so that a comparison engine
sees the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import tag_literal
from tallyloom.session import pin


class Tables:
    """Test tables of one folder, read with column pruning left to Spark."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = pin(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def posts(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("creator"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        day.alias("day"),
        F.month(day).alias("month"),
        F.col("o_orderpriority").alias("language"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("likes"),
    )


def post_engagement(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("num_replies"), F.sum(F.col("l_quantity").cast("int")).alias("reshares")
    )
    return posts(t).join(lines, "id")


def baskets(t: Tables) -> DataFrame:
    """Sorted distinct brands per order; a set of brands is never longer than the brand list."""
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.array_sort(F.collect_set("p_brand")).alias("items"))
    )


def tag_strings(t: Tables) -> DataFrame:
    """Every post with its tags written as a list literal, ``[]`` when it has none."""
    tags = F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda b: F.concat(F.lit("#"), b))
    return posts(t).join(baskets(t), "id", "left").select(
        "id", "creator", "language", "day", "month", tag_literal(tags).alias("hashtags")
    )


def texts(t: Tables) -> DataFrame:
    docs = t.documents.select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("lang").alias("language"),
        F.col("source").alias("creator"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).alias("day"),
    )
    return docs


def raw_pages(t: Tables) -> DataFrame:
    return t.pages


def vectors(t: Tables) -> DataFrame:
    return t.embeddings


def event_rows(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("series"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def occupancy_hourly(t: Tables) -> DataFrame:
    return (
        event_rows(t)
        .groupBy(F.col("series").alias("code"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg("value").alias("label"))
    )


def area_hourly(t: Tables) -> DataFrame:
    return (
        event_rows(t)
        .groupBy((F.col("user_id") % 7 + 1).cast("int").alias("cluster"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.count(F.lit(1)).cast("double").alias("count"))
    )


def weather_hourly(t: Tables) -> DataFrame:
    return (
        event_rows(t)
        .filter(F.col("series") == "view")
        .groupBy(F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg("value").alias("temperature"))
    )


SQL = {
    "posts": """posts AS (
  SELECT o_orderkey AS id, o_custkey AS creator, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day,
         CAST(month(o_orderdate) AS INT) AS month, o_orderpriority AS language,
         CAST(o_totalprice AS DECIMAL(18,2)) AS likes
  FROM orders)""",
    "post_engagement": """post_engagement AS (
  SELECT p.*, l.num_replies, l.reshares FROM posts p JOIN (
    SELECT l_orderkey AS id, count(*) AS num_replies, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS reshares
    FROM lineitem GROUP BY 1) l USING (id))""",
    "basket_items": """basket_items AS (
  SELECT DISTINCT l_orderkey AS id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "tagged": """tagged AS (
  SELECT p.id, p.creator, p.language, p.day, p.month, CASE WHEN b.item IS NULL THEN NULL ELSE '#' || b.item END AS tag
  FROM posts p LEFT JOIN basket_items b ON p.id = b.id)""",
    "texts": """texts AS (
  SELECT doc_id AS id, text, lang AS language, source AS creator,
         DATE '2024-01-01' + CAST(doc_id % 366 AS INT) AS day FROM documents)""",
    "words": r"""words AS (
  SELECT id, language, w AS word, pos FROM (
    SELECT id, language, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (
      SELECT id, language, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 2) AS ws
      FROM texts)))""",
    "event_rows": """event_rows AS (
  SELECT event_id, user_id, event_type AS series, ts, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "occupancy_hourly": """occupancy_hourly AS (
  SELECT series AS code, date_trunc('hour', ts) AS ts, avg(value) AS label FROM event_rows GROUP BY 1, 2)""",
    "area_hourly": """area_hourly AS (
  SELECT CAST(user_id % 7 + 1 AS INT) AS cluster, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS cnt
  FROM event_rows GROUP BY 1, 2)""",
    "weather_hourly": """weather_hourly AS (
  SELECT date_trunc('hour', ts) AS ts, avg(value) AS temperature FROM event_rows WHERE series = 'view' GROUP BY 1)""",
}

NEEDS = {
    "post_engagement": ("posts",),
    "tagged": ("posts", "basket_items"),
    "words": ("texts",),
    "occupancy_hourly": ("event_rows",),
    "area_hourly": ("event_rows",),
    "weather_hourly": ("event_rows",),
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """Comparison SQL: the named views with what they need, further CTEs, and the query."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = [SQL[n] for n in order] + ([extra.strip().rstrip(",")] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
