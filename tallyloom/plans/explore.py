"""Counts, ranks, shares, bands and set operations over posts and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.text import parse_tags, real_tags
from tallyloom.operators import counts
from tallyloom.plans.registry import query, steady
from tallyloom.plans.views import Tables, baskets, post_engagement, posts, tag_strings, texts, with_views
from tallyloom.sources.named import register

# The category that plays the undecided language in the test data.
UNDECIDED = "5-LOW"
LANGUAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LANGUAGE_COLUMNS = ["urgent", "high", "medium", "unspecified", "low"]


def tagged_posts(t: Tables):
    return tag_strings(t).withColumn("items", real_tags(parse_tags(F.col("hashtags"))))


@query("filter_category", with_views("posts", """
SELECT id, creator, CAST(likes AS DOUBLE) AS likes FROM posts WHERE language = '2-HIGH'"""))
def filter_category(t: Tables):
    """Posts of one language."""
    return posts(t).filter(F.col("language") == "2-HIGH").select(
        "id", "creator", F.col("likes").cast("double").alias("likes")
    )


@query("count_by_month", with_views("posts", """
SELECT month, count(*) AS n FROM posts WHERE month IS NOT NULL GROUP BY 1"""))
def count_by_month(t: Tables):
    return counts.count_by(posts(t), "month")


@query("count_by_month_lang", with_views("posts", """
SELECT month, language, count(*) AS n FROM posts GROUP BY 1, 2"""))
def count_by_month_lang(t: Tables):
    return counts.count_by(posts(t), "month", "language")


@query("count_by_month_lang_pivot", with_views("posts", """
SELECT month,
  CAST(count_if(language = '1-URGENT') AS BIGINT) AS urgent, CAST(count_if(language = '2-HIGH') AS BIGINT) AS high,
  CAST(count_if(language = '3-MEDIUM') AS BIGINT) AS medium,
  CAST(count_if(language = '4-NOT SPECIFIED') AS BIGINT) AS unspecified,
  CAST(count_if(language = '5-LOW') AS BIGINT) AS low
FROM posts GROUP BY 1"""))
def count_by_month_lang_pivot(t: Tables):
    """Monthly counts of five languages in one pass, one column each."""
    return counts.count_pivot(posts(t), "month", "language", LANGUAGES, LANGUAGE_COLUMNS)


@query("langs_per_month", with_views("posts", """
SELECT month, count(DISTINCT language) AS languages FROM posts WHERE language <> '5-LOW' GROUP BY 1"""))
def langs_per_month(t: Tables):
    return counts.categories_per_group(posts(t), "month", "language", [UNDECIDED], "languages")


@query("daily_count", with_views("posts", """
SELECT day, count(*) AS n FROM posts GROUP BY 1"""))
def daily_count(t: Tables):
    return counts.count_by(posts(t), "day")


@query("daily_count_lang", with_views("posts", """
SELECT day, language, count(*) AS n FROM posts WHERE language IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2"""))
def daily_count_lang(t: Tables):
    two = posts(t).filter(F.col("language").isin("1-URGENT", "2-HIGH"))
    return counts.count_by(two, "day", "language")


@query("topk_group_share", with_views("posts", """
SELECT month, creator, n, CAST(rank AS INT) AS rank, CAST(round(TRY_CAST(percent AS DECIMAL(28,9)), 6) AS DOUBLE) AS percent FROM (
  SELECT month, creator, n, row_number() OVER (PARTITION BY month ORDER BY n DESC, creator) AS rank,
         100.0 * n / sum(n) OVER (PARTITION BY month) AS percent
  FROM (SELECT month, creator, count(*) AS n FROM posts GROUP BY 1, 2)) WHERE rank <= 5"""))
def topk_group_share(t: Tables):
    """The five most frequent creators of each month with their percentage."""
    best = counts.top_share_in_group(posts(t), "month", "creator", 5)
    return best.withColumn("percent", steady("percent", 6))


@query("union_monthly", with_views("posts", """
SELECT month, count(*) AS n, 'all' AS language FROM posts GROUP BY 1
UNION ALL SELECT month, count(*), language FROM posts WHERE language IN ('1-URGENT', '2-HIGH') GROUP BY 1, 3"""))
def union_monthly(t: Tables):
    """All posts per month stacked with two languages, each row tagged."""
    p = posts(t)
    overall = counts.count_by(p, "month").withColumn("language", F.lit("all"))
    two = p.filter(F.col("language").isin("1-URGENT", "2-HIGH"))
    return overall.unionByName(counts.count_by(two, "month", "language"))


@query("missing_categories", with_views("posts", """
SELECT CAST(m.month AS INT) AS month, c.creator
FROM (SELECT unnest(range(1, 13)) AS month) m CROSS JOIN (SELECT DISTINCT creator FROM posts) c
WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.month = m.month AND p.creator = c.creator)"""))
def missing_categories(t: Tables):
    """Creators without a post in a month, for all twelve months in one query."""
    return counts.missing_categories(
        posts(t), "month", "creator", F.sequence(F.lit(1), F.lit(12))
    )


@query("distinct_values", with_views("posts", """
SELECT count(DISTINCT creator) AS creators, count(DISTINCT language) AS languages, count(DISTINCT day) AS days
FROM posts"""))
def distinct_values(t: Tables):
    return posts(t).agg(
        F.count_distinct("creator").alias("creators"),
        F.count_distinct("language").alias("languages"),
        F.count_distinct("day").alias("days"),
    )


@query("posts_per_creator", with_views("posts", """
SELECT creator, count(*) AS n FROM posts GROUP BY 1"""))
def posts_per_creator(t: Tables):
    return counts.count_by(posts(t), "creator").orderBy(F.desc("n"), "creator")


@query("active_creators_band", with_views("posts", """
SELECT id, creator FROM posts WHERE creator IN (
  SELECT creator FROM posts GROUP BY 1 HAVING count(*) > 15 AND count(*) < 40)"""))
def active_creators_band(t: Tables):
    """Posts of creators whose number of posts lies in a band."""
    return counts.rows_of_band(posts(t).select("id", "creator"), "creator", 15, 40)


@query("posts_of_creators", with_views("posts", """
SELECT id, creator, language FROM posts WHERE creator IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""))
def posts_of_creators(t: Tables):
    """Posts of a list of creators, by semi join."""
    wanted = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("creator"))
    return counts.rows_of_keys(posts(t).select("id", "creator", "language"), "creator", wanted)


@query("argmax_per_month", with_views("posts", """
SELECT id, month, CAST(likes AS DOUBLE) AS likes FROM posts WHERE (likes, month) IN (
  SELECT (max(likes), month) FROM posts GROUP BY month)"""))
def argmax_per_month(t: Tables):
    """Posts that reach the greatest number of likes of their month."""
    best = counts.rows_at_group_max(posts(t).select("id", "month", "likes"), "month", "likes")
    return best.withColumn("likes", F.col("likes").cast("double"))


@query("enrich_join", with_views("texts", """
SELECT t.id, t.language, l.quality, l.toxic FROM texts t JOIN labels l ON t.id = l.doc_id"""))
def enrich_join(t: Tables):
    """Texts joined with their labels on id."""
    labels = t.labels.withColumnRenamed("doc_id", "id")
    return counts.enrich(texts(t).select("id", "language"), labels, "id")


@query("tag_counts", with_views("tagged", """
SELECT language, tag, count(*) AS n FROM tagged WHERE tag IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'all', tag, count(*) FROM tagged WHERE tag IS NOT NULL GROUP BY 2"""))
def tag_counts(t: Tables):
    """Uses of each tag, overall and per language; the overall counts come from the per-language ones."""
    per = counts.exploded_counts(tagged_posts(t), "items", "language", out="tag")
    every = per.groupBy("tag").agg(F.sum("n").alias("n")).withColumn("language", F.lit("all"))
    return every.unionByName(per)


@query("top_tags", with_views("tagged", """
SELECT tag, count(*) AS n FROM tagged WHERE tag IS NOT NULL GROUP BY 1 ORDER BY n DESC, tag LIMIT 10"""))
def top_tags(t: Tables):
    """The ten most used tags."""
    per = counts.exploded_counts(tagged_posts(t), "items", out="tag")
    return counts.top_rows(per, 10, F.desc("n"), F.asc("tag"))


@query("terms_per_day", with_views("tagged", """
SELECT day, tag, count(*) AS n FROM tagged WHERE tag IS NOT NULL GROUP BY 1, 2"""))
def terms_per_day(t: Tables):
    """Uses of each tag on each day."""
    return counts.exploded_counts(tagged_posts(t), "items", "day", out="tag")


@query("tag_cardinality", with_views("tagged", """
SELECT language, CAST(bucket AS INT) AS bucket, n, CAST(round(TRY_CAST(n / sum(n) OVER (PARTITION BY language) AS DECIMAL(28,9)), 6) AS DOUBLE) AS share,
  CASE WHEN bucket > 0 THEN
    CAST(round(TRY_CAST(n / sum(CASE WHEN bucket > 0 THEN n END) OVER (PARTITION BY language) AS DECIMAL(28,9)), 6) AS DOUBLE) END AS share_tagged
FROM (SELECT language, least(size, 6) AS bucket, count(*) AS n
      FROM (SELECT id, language, count(tag) AS size FROM tagged GROUP BY 1, 2) GROUP BY 1, 2)"""))
def tag_cardinality(t: Tables):
    """Posts with 0, 1 .. 5 and more tags, per language."""
    h = counts.size_histogram(tagged_posts(t), "items", "language")
    return h.withColumns({c: steady(c, 6) for c in ("share", "share_tagged")})


@query("tag_replication", with_views("tagged", """
SELECT language, posts, tags, distinct_tags,
  CAST(round(TRY_CAST(tags / max(tags) OVER () AS DECIMAL(28,9)), 6) AS DOUBLE) AS share_tags,
  CAST(round(TRY_CAST(distinct_tags / max(CASE WHEN language = 'all' THEN distinct_tags END) OVER () AS DECIMAL(28,9)), 6) AS DOUBLE) AS share_distinct,
  CAST(round(TRY_CAST(tags / posts AS DECIMAL(28,9)), 6) AS DOUBLE) AS tags_per_post, CAST(round(TRY_CAST(tags / distinct_tags AS DECIMAL(28,9)), 6) AS DOUBLE) AS uses_per_tag
FROM (SELECT language, count(DISTINCT id) AS posts, count(tag) AS tags, count(DISTINCT tag) AS distinct_tags
      FROM tagged GROUP BY 1
      UNION ALL SELECT 'all', count(DISTINCT id), count(tag), count(DISTINCT tag) FROM tagged)"""))
def tag_replication(t: Tables):
    r = counts.tag_replication(tagged_posts(t), "language", "items")
    return r.withColumns(
        {c: steady(c, 6) for c in ("share_tags", "share_distinct", "tags_per_post", "uses_per_tag")}
    )


@query("exclusive_terms", """
WITH pairs AS (SELECT DISTINCT label, source AS term FROM embeddings JOIN documents ON vec_id = doc_id
  UNION SELECT DISTINCT label, url AS term FROM embeddings JOIN pages ON vec_id = page_id)
SELECT min(label) AS label, term FROM pairs GROUP BY term HAVING count(DISTINCT label) = 1""")
def exclusive_terms(t: Tables):
    """Terms that occur under one cluster only."""
    return counts.exclusive_terms(cluster_terms(t), "label", "term")


@query("common_terms", """
WITH pairs AS (SELECT DISTINCT label, source AS term FROM embeddings JOIN documents ON vec_id = doc_id
  UNION SELECT DISTINCT label, url AS term FROM embeddings JOIN pages ON vec_id = page_id)
SELECT term FROM pairs GROUP BY term HAVING count(DISTINCT label) = (SELECT count(DISTINCT label) FROM pairs)""")
def common_terms(t: Tables):
    """Terms that occur under every cluster."""
    return counts.common_terms(cluster_terms(t), "label", "term")


def cluster_terms(t: Tables):
    e = t.embeddings.select("vec_id", "label")
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("source").alias("term"))
    urls = t.pages.select(F.col("page_id").alias("vec_id"), F.col("url").alias("term"))
    return e.join(docs.unionByName(urls), "vec_id").select("label", "term")


@query("cluster_share", """
SELECT label, count(*) AS n, CAST(round(TRY_CAST(count(*) / (SELECT count(*) FROM embeddings) AS DECIMAL(28,9)), 6) AS DOUBLE) AS share
FROM embeddings GROUP BY 1""")
def cluster_share(t: Tables):
    return counts.share_of_total(t.embeddings, "label").withColumn("share", steady("share", 6))


@query("engagement_rank", with_views("post_engagement", """
SELECT creator, CAST(sum(reshares) AS BIGINT) AS reshares, CAST(sum(num_replies) AS BIGINT) AS num_replies
FROM post_engagement GROUP BY 1"""))
def engagement_rank(t: Tables):
    """Reshares and replies per creator."""
    return post_engagement(t).groupBy("creator").agg(
        F.sum("reshares").alias("reshares"), F.sum("num_replies").alias("num_replies")
    )


@query("array_lower_distinct", """
SELECT l_orderkey AS id, string_agg(b, ',' ORDER BY b) AS items FROM (
  SELECT DISTINCT l_orderkey, lower(p_brand) AS b FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def array_lower_distinct(t: Tables):
    """Lower-case distinct array elements in sorted order."""
    from tallyloom.functions.text import lower_distinct

    doubled = F.concat("items", F.transform("items", F.upper))
    return baskets(t).select("id", F.array_join(lower_distinct(doubled), ",").alias("items"))


@query("named_views", with_views("posts", """
SELECT creator, count(*) AS n FROM posts WHERE creator IN (
  SELECT creator FROM posts GROUP BY creator HAVING count(*) > 5) GROUP BY 1"""))
def named_views(t: Tables):
    """Posts of creators with more than five, asked in SQL over a named frame."""
    register(tallyloom_posts=posts(t))
    return t.spark.sql(
        "SELECT creator, count(*) AS n FROM tallyloom_posts WHERE creator IN ("
        "SELECT creator FROM tallyloom_posts GROUP BY creator HAVING count(*) > 5) GROUP BY creator"
    )
