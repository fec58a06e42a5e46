"""Files in and out, cleaning, parsing and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions import timeparts as tp
from tallyloom.operators import cleaning
from tallyloom.plans.registry import query, steady
from tallyloom.plans.views import Tables, area_hourly, baskets, event_rows, posts, raw_pages, tag_strings, texts, with_views
from tallyloom.sources import csvs, html, logs
from tallyloom.storage import scratch_path

DAY = "yyyy-MM-dd"
MINUTE = "yyyy-MM-dd HH:mm"


def typed_posts(t: Tables):
    """Documents as posts: tags from the basket of the same id, counters from the id."""
    minute = F.expr("CAST(day AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, CAST(id % 1440 AS INT), 0)")
    return texts(t).join(baskets(t), "id", "left").select(
        F.col("id").cast("string").alias("id"),
        "creator",
        F.coalesce("items", F.array().cast("array<string>")).alias("hashtags"),
        minute.alias("ts"),
        (F.col("id") % 11).cast("int").alias("reshares"),
        (F.col("id") % 13).cast("int").alias("likes"),
        (F.col("id") % 7).cast("int").alias("num_replies"),
        "text",
        tx.clean_text(F.col("text")).alias("clean_text"),
    )


POST_ROWS_SQL = r"""
SELECT CAST(x.id AS VARCHAR) AS id, x.creator, coalesce(b.tags, 0) AS tags,
  strftime(CAST(x.day AS TIMESTAMP) + to_minutes(x.id % 1440), '%Y-%m-%d %H:%M') AS minute,
  CAST(x.id % 11 AS INT) AS reshares, CAST(x.id % 13 AS INT) AS likes, CAST(x.id % 7 AS INT) AS num_replies"""

CLEAN_SQL = rf"""trim(regexp_replace(regexp_replace(text, '{tx.NOISE}', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("src_csv_roundtrip", with_views("texts basket_items", POST_ROWS_SQL + f""",
  md5(x.text) AS text_hash, length({CLEAN_SQL}) AS clean_length
FROM texts x LEFT JOIN (SELECT id, count(*) AS tags FROM basket_items GROUP BY 1) b ON x.id = b.id"""))
def src_csv_roundtrip(t: Tables):
    """Posts written to headered, multi-line CSV and read back with declared types."""
    path = scratch_path(t.spark, "posts-csv")
    csvs.write_posts(typed_posts(t), path)
    return csvs.read_posts(t.spark, path).select(
        "id",
        "creator",
        F.size("hashtags").cast("bigint").alias("tags"),
        F.date_format("ts", MINUTE).alias("minute"),
        "reshares",
        "likes",
        "num_replies",
        F.md5("text").alias("text_hash"),
        F.length("clean_text").cast("bigint").alias("clean_length"),
    )


@query("src_positional_csv", """
SELECT CAST(user_id AS INT) AS code, CAST(floor(value) AS INT) AS free, 'd' || CAST(isodow(ts) AS VARCHAR) AS weekday,
  CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour
FROM events""")
def src_positional_csv(t: Tables):
    """Headerless rows written and read back by position; the hour is the first two signs of the time."""
    path = scratch_path(t.spark, "parking-csv")
    ts = F.col("ts")
    rows = event_rows(t).select(
        "user_id",
        F.floor("value").cast("int").alias("free"),
        F.concat(F.lit("d"), F.weekday(ts) + 1).alias("weekday"),
        F.date_format(ts, "MM").alias("month"),
        F.date_format(ts, "dd").alias("day"),
        F.date_format(ts, "yyyy").alias("year"),
        F.date_format(ts, "HH:mm:ss").alias("hour"),
    )
    rows.write.csv(path)
    return csvs.read_parking(t.spark, path)


def log_lines(t: Tables):
    """Orders as parking readings: the site is the customer's nation."""
    stamp = F.expr("ts + make_interval(0, 0, 0, 0, 0, CAST(id % 1440 AS INT), 0)")
    lines = posts(t).select(
        "id", (F.col("creator") % 25).cast("int").alias("code"), stamp.alias("ts")
    )
    zone = F.when(F.month("ts").between(4, 9), "GMT+0200 (CEST)").otherwise("GMT+0100 (CET)")
    return lines.select(
        (F.col("code") % 5).alias("region"),
        F.concat(
            F.lit("Parking "), F.col("code") + 100, F.lit("(Site "), F.col("code"), F.lit("): "),
            F.col("id") % 500, F.lit(" free parking @"), F.date_format("ts", "EEE MMM dd yyyy HH:mm:ss "), zone,
        ).alias("value"),
    )


LOG_SQL = """stamped AS (
  SELECT id, CAST(creator % 25 AS INT) AS code, ts + to_minutes(id % 1440) AS seen FROM posts),
season AS (SELECT * FROM stamped WHERE year(seen) = 1997 AND month(seen) BETWEEN 6 AND 10)"""


@query("parse_park_log", with_views("posts", """
SELECT 'Parking ' || (code + 100) || '(Site ' || code || ')' AS site, CAST(id % 500 AS INT) AS free,
  'd' || isodow(seen) AS weekday, CAST(month(seen) AS INT) AS month, CAST(day(seen) AS INT) AS day,
  CAST(year(seen) AS INT) AS year, strftime(seen, '%H:%M:%S') AS hour FROM season""", LOG_SQL))
def parse_park_log(t: Tables):
    """Raw log lines to fields, in-season lines of one year only."""
    return logs.parse_log(log_lines(t), year=1997)


@query("ingest_multi_source", with_views("posts", """
SELECT CAST(n_nationkey + 100 AS INT) AS name, n_regionkey AS area, count(*) AS n, CAST(sum(id % 500) AS BIGINT) AS free
FROM season JOIN nation ON n_nationkey = code GROUP BY 1, 2""", LOG_SQL))
def ingest_multi_source(t: Tables):
    """Five log folders read as one dataset; code and area come from the site table."""
    path = scratch_path(t.spark, "logs")
    log_lines(t).write.partitionBy("region").text(path)
    sites = t.nation.select(
        F.concat(
            F.lit("Parking "), F.col("n_nationkey") + 100, F.lit("(Site "), F.col("n_nationkey"), F.lit(")")
        ).alias("site"),
        (F.col("n_nationkey") + 100).cast("int").alias("code"),
        F.col("n_regionkey").alias("area"),
    )
    rows = logs.read_logs(t.spark, [f"{path}/region={r}" for r in range(5)], sites, year=1997)
    readings = rows.select("area", *logs.positional(rows).columns[1:2], F.col("code").alias("name"))
    return readings.groupBy("name", "area").agg(F.count(F.lit(1)).alias("n"), F.sum("free").alias("free"))


@query("csv_flatten", """
SELECT o_orderkey || ' ' || o_orderpriority || ' ' || o_orderstatus AS line FROM orders""")
def csv_flatten(t: Tables):
    """Chosen fields of each row as one line of text, written and read back."""
    path = scratch_path(t.spark, "flat")
    csvs.flat_lines(t.orders, ["o_orderkey", "o_orderpriority", "o_orderstatus"]).write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


STRIP_SQL = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
BODY_SQL = "regexp_replace(h, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"


@query("html_extract", rf"""
SELECT page_id, regexp_extract(h, '<title>(.*?)</title>', 1) AS title,
  {STRIP_SQL.format("regexp_extract(h, '<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  array_to_string(regexp_extract_all(h, '<a\s[^>]*href="([^"]*)"', 1), '|') AS links,
  md5({STRIP_SQL.format(BODY_SQL)}) AS visible,
  md5({STRIP_SQL.format("regexp_replace(" + BODY_SQL + ", '(?s)<a\\s.*?</a>', '', 'g')")}) AS unlinked
FROM (SELECT page_id, replace(html, chr(10), '') AS h FROM pages)""")
def html_extract(t: Tables):
    """Title, heading, links and visible text with and without anchors, for every page."""
    f = html.page_fields(raw_pages(t))
    return f.select(
        "page_id", "title", "heading", F.array_join("links", "|").alias("links"),
        F.md5("visible").alias("visible"), F.md5("unlinked").alias("unlinked"),
    )


def rendered_posts(t: Tables):
    """Typed posts rendered as result pages of twenty list items."""
    p = typed_posts(t).filter(F.col("id").isNotNull())
    month = F.element_at(F.array(*[F.lit(m) for m in tp.ITALIAN_MONTHS]), F.month("ts"))
    anchors = F.array_join(
        F.transform(
            "hashtags", lambda h: F.concat(F.lit('<a href="/hashtag/x" class="tag"><s>#</s><b>'), h, F.lit("</b></a>"))
        ),
        " ",
    )

    def count(action: str, cell: str):
        shown = F.when(F.col(cell) == 0, "").otherwise(F.col(cell).cast("string"))
        return F.concat(
            F.lit(f'<div class="ProfileTweet-action ProfileTweet-action--{action}"><button><span '),
            F.lit('class="ProfileTweet-actionCountForPresentation">'), shown, F.lit("</span></button></div>"),
        )

    item = F.concat(
        F.lit('<li class="js-stream-item stream-item" data-item-id="'), F.col("id"),
        F.lit('"><div class="tweet js-stream-tweet" data-screen-name="'), F.col("creator"),
        F.lit('"><a href="/status" class="tweet-timestamp js-permalink" title="'),
        F.date_format("ts", "HH:mm - d "), month, F.date_format("ts", " yyyy"), F.lit('">x</a>'),
        F.lit('<div class="js-tweet-text-container"><p>\n'), F.col("clean_text"), F.lit(" "), anchors, F.lit("</p></div>"),
        count("reply", "num_replies"), count("retweet", "reshares"), count("favorite", "likes"),
        F.lit("</div></li>"),
    )
    page = F.floor(F.col("id").cast("bigint") / 20).alias("page")
    pages = p.select(page, item.alias("item")).groupBy("page").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    return pages.select(
        "page", F.concat(F.lit('<html><body><div class="stream"><ol>'), "items", F.lit("</ol></div></body></html>")).alias("html")
    )


@query("post_pages_extract", with_views("texts basket_items", POST_ROWS_SQL + f""",
  md5({CLEAN_SQL}) AS clean_hash,
  md5({CLEAN_SQL} || ' ' || coalesce(b.list, '')) AS text_hash
FROM texts x LEFT JOIN (
  SELECT id, count(*) AS tags, string_agg('#' || item, ' ' ORDER BY item) AS list FROM basket_items GROUP BY 1
) b ON x.id = b.id"""))
def post_pages_extract(t: Tables):
    """Post records taken out of result pages: nine fields per list item."""
    got = html.posts_of_pages(rendered_posts(t))
    return got.select(
        "id", "creator", F.size("hashtags").cast("bigint").alias("tags"), F.date_format("ts", MINUTE).alias("minute"),
        "reshares", "likes", "num_replies", F.md5(F.rtrim("clean_text")).alias("clean_hash"), F.md5("text").alias("text_hash"),
    )


@query("clean_nulls", """
SELECT count(*) AS rows_before, count(quality) AS rows_after, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS counted
FROM documents LEFT JOIN labels USING (doc_id)""")
def clean_nulls(t: Tables):
    """Rows before and after the null drop, and empty counters read as 0."""
    raw = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    cell = F.coalesce(F.col("quality").cast("string"), F.lit(""))
    marked = raw.withColumn("counter", tp.count_or_zero(cell))
    after = cleaning.drop_nulls(marked.select("doc_id", "quality")).agg(F.count(F.lit(1)).alias("n"))
    return marked.agg(F.count(F.lit(1)).alias("rows_before"), F.sum("counter").alias("counted")).withColumn(
        "rows_after", after.scalar()
    )


@query("parse_post_time", with_views("posts", """
SELECT id, CASE WHEN id % 10 < 8 THEN strftime(ts + to_minutes(id % 1440), '%Y-%m-%d %H:%M') END AS minute,
  CASE WHEN id % 10 < 8 THEN CAST(ts + to_minutes(id % 1440) AS DATE) END AS day FROM posts"""))
def parse_post_time(t: Tables):
    """Post clock text to typed time: month tokens, unpadded days, empty and broken cells."""
    stamp = F.expr("ts + make_interval(0, 0, 0, 0, 0, CAST(id % 1440 AS INT), 0)")
    month = F.element_at(F.array(*[F.lit(m) for m in tp.ITALIAN_MONTHS]), F.month("at"))
    raw = F.concat(F.date_format("at", "HH:mm - d "), month, F.date_format("at", " yyyy"))
    cell = F.when(F.col("id") % 10 < 8, raw).when(F.col("id") % 10 == 8, "").otherwise("yesterday")
    spread = posts(t).select("id", "ts")
    cells = spread.withColumn("at", stamp).select("id", tp.normal_post_time(cell).alias("clock"))
    return cells.select(
        "id", F.date_format(tp.post_timestamp(F.col("clock")), MINUTE).alias("minute"),
        tp.post_date(F.col("clock")).alias("day"),
    )


@query("parse_tag_array", with_views("tagged", """
SELECT id, tag, CAST(row_number() OVER (PARTITION BY id ORDER BY tag) AS INT) - 1 AS pos FROM tagged WHERE tag IS NOT NULL
UNION ALL SELECT id, '', 0 FROM tagged WHERE tag IS NULL"""))
def parse_tag_array(t: Tables):
    """List-literal cells to arrays, one row per element; ``[]`` gives one empty element."""
    return tag_strings(t).select("id", F.posexplode(tx.parse_tags(F.col("hashtags"))).alias("pos", "tag"))


@query("parse_tag_array_raw", with_views("tagged", """
SELECT id, CASE WHEN pos > 0 THEN ' ' ELSE '' END || '''' || tag || '''' AS tag, CAST(pos AS INT) AS pos FROM (
  SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY tag) - 1 AS pos FROM tagged WHERE tag IS NOT NULL)
UNION ALL SELECT id, '', 0 FROM tagged WHERE tag IS NULL"""))
def parse_tag_array_raw(t: Tables):
    """The same without stripping: quotes and leading blanks stay."""
    return tag_strings(t).select("id", F.posexplode(tx.parse_tags(F.col("hashtags"), strip=False)).alias("pos", "tag"))


@query("clean_text", with_views("texts", f"SELECT id, {CLEAN_SQL} AS clean FROM texts"))
def clean_text(t: Tables):
    """Texts without handles, links and signs."""
    return texts(t).select("id", tx.clean_text(F.col("text")).alias("clean"))


@query("calendar_parts", with_views("event_rows", """
SELECT event_id, CAST(month(ts) AS INT) AS month, CAST(year(ts) AS INT) AS year, CAST(day(ts) AS INT) AS day,
  CAST(hour(ts) AS INT) AS hour FROM event_rows WHERE CAST(ts AS DATE) = DATE '2024-01-15'"""))
def calendar_parts(t: Tables):
    """Calendar parts of the events of one day."""
    ts = F.col("ts")
    one = event_rows(t).filter(F.to_date(ts) == F.lit("2024-01-15").cast("date"))
    return one.select(
        "event_id", F.month(ts).alias("month"), F.year(ts).alias("year"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour")
    )


@query("hour_key", with_views("event_rows", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:00') AS hour, CAST(ts AS DATE) AS day FROM event_rows"""))
def hour_key(t: Tables):
    """Typed hour and day keys built from calendar parts."""
    ts = F.col("ts")
    key = tp.hour_from_parts(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts))
    day = F.make_date(F.year(ts), F.month(ts), F.dayofmonth(ts))
    return event_rows(t).select("event_id", F.date_format(key, MINUTE).alias("hour"), day.alias("day"))


@query("tz_shift", with_views("posts", """
SELECT id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome', '%Y-%m-%d %H:%M') AS local FROM posts"""))
def tz_shift(t: Tables):
    """UTC times on a local clock, summer time included."""
    return posts(t).select("id", F.date_format(tp.to_local(F.col("ts"), "Europe/Rome"), MINUTE).alias("local"))


@query("series_slice", with_views("posts", """
SELECT day, count(*) AS n FROM posts WHERE day BETWEEN DATE '1997-06-04' AND DATE '1997-10-27' GROUP BY 1"""))
def series_slice(t: Tables):
    """Daily counts between two days, both included."""
    part = cleaning.between(posts(t), "day", "1997-06-04", "1997-10-27")
    return part.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("series_gaps", with_views("posts", """
SELECT language, day FROM (
  SELECT language, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM posts GROUP BY 1) g
WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.language = g.language AND p.day = g.day)"""))
def series_gaps(t: Tables):
    """Days without a post, per language."""
    return cleaning.gaps(posts(t).select("language", "day").distinct(), ["language"], "day", "1 DAY")


@query("series_grid", with_views("posts", """
SELECT g.language, g.day, CAST(row_number() OVER (PARTITION BY g.language ORDER BY g.day) - 1 AS INT) AS pos, c.n AS y FROM (
  SELECT language, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM posts GROUP BY 1) g
LEFT JOIN (SELECT language, day, CAST(count(*) AS DOUBLE) AS n FROM posts GROUP BY 1, 2) c
  ON c.language = g.language AND c.day = g.day"""))
def series_grid(t: Tables):
    """Daily counts on the full daily grid; days without posts stay empty."""
    daily = posts(t).groupBy("language", "day").agg(F.count(F.lit(1)).alias("y"))
    return cleaning.on_grid(daily, ["language"], "day", "y", "1 DAY")


@query("hourly_occupancy", with_views("event_rows", """
SELECT series, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, CAST(round(TRY_CAST(avg(value) AS DECIMAL(28,9)), 6) AS DOUBLE) AS value FROM event_rows
WHERE month(ts) BETWEEN 1 AND 10 AND year(ts) = 2024 GROUP BY 1, 2"""))
def hourly_occupancy(t: Tables):
    """Mean value per key and hour, inside a range of months of one year."""
    kept = event_rows(t).filter(F.month("ts").between(1, 10) & (F.year("ts") == 2024))
    mean = cleaning.mean_per_hour(kept, ["series"], "ts", "value")
    return mean.select("series", F.date_format("ts", MINUTE).alias("hour"), steady("value", 6).alias("value"))


@query("daily_area_mean", with_views("area_hourly", """
SELECT cluster, CAST(ts AS DATE) AS day, CAST(round(TRY_CAST(avg(cnt) AS DECIMAL(28,9)), 6) AS DOUBLE) AS count FROM area_hourly GROUP BY 1, 2"""))
def daily_area_mean(t: Tables):
    """Daily mean of hourly counts per area."""
    mean = cleaning.mean_per_day(area_hourly(t), ["cluster"], "ts", "count")
    return mean.withColumn("count", steady("count", 6))
