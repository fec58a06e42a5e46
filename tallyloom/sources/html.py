"""Records from saved pages, with JVM-side pattern functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.markup import GAP, RAW, REST, attribute, content, open_tags, without_comments
from tallyloom.functions.text import drop_anchors, strip_tags, text_content
from tallyloom.functions.timeparts import count_or_zero, normal_post_time, null_if_unknown, post_timestamp

# Marks of one post in a saved result page.
POST_START = rf'<li\b{GAP}\sclass="js-stream-item'
ID_MARK = r'data-item-id="([^"]*)"'
CREATOR_MARK = r'data-screen-name="([^"]*)"'
TAG_MARK = rf'(?s)<a\b{GAP}\shref="/hashtag[^"]*"{REST}>(.*?)</a>'
TEXT_MARK = rf'<div\b{GAP}\sclass="js-tweet-text-container"{REST}>'
TIME_MARK = rf'<a\b(?={GAP}\sclass="tweet-timestamp){GAP}\stitle="([^"]*)"'
ACTION_MARK = rf'<div\b{GAP}\sclass="[^"]*ProfileTweet-action--'
COUNT_MARK = rf'(?s)<span\b{GAP}\sclass="ProfileTweet-actionCountForPresentation"{REST}>(.*?)</span>'


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Saved pages, one row per file, without line breaks."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("url"), F.regexp_replace("value", "[\r\n]", "").alias("html")
    )


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, heading, link targets and visible text of each page. Scripts, styles and comments hold
    none of them; an end of tag inside quotes ends nothing."""
    plain = without_comments(F.regexp_replace(F.regexp_replace(F.col(html), "\n", ""), RAW, " "))
    # a column of its own, so that it is made once for all fields
    body = F.col("_body")
    named = {
        "title": F.regexp_extract(body, rf"(?is)<title\b{REST}>(.*?)</title\s*+>", 1),
        "heading": strip_tags(F.regexp_extract(body, rf"(?is)<h1\b{REST}>(.*?)</h1\s*+>", 1)),
        "links": F.array_compact(F.transform(open_tags(body, "a"), lambda t: attribute(t, "href"))),
        "visible": strip_tags(body),
        "unlinked": strip_tags(drop_anchors(body)),
    }
    return pages.withColumn("_body", plain).withColumns(named).drop("_body")


def counter(blocks: Column, action: str) -> Column:
    """Counter of one action, 0 when it is empty or absent; grouped digits count as one number.

    ``blocks`` is what stands between the action marks of a post."""
    own = F.filter(blocks, lambda b: b.startswith(action) & F.regexp_like(b, F.lit(COUNT_MARK)))
    return count_or_zero(F.regexp_extract(F.coalesce(F.get(own, F.lit(0)), F.lit("")), COUNT_MARK, 1))


def posts_of_pages(pages: DataFrame, html: str = "html", greedy: bool = False) -> DataFrame:
    """One row per post element: page columns kept, nine post fields added."""
    parts = F.split(without_comments(F.regexp_replace(F.col(html), "\n", "")), f"(?={POST_START})")
    others = [c for c in pages.columns if c != html]
    f = F.col("_fragment")
    split = pages.select(*others, F.explode(F.slice(parts, 1, F.size(parts))).alias("_fragment"))
    posts = split.filter(F.regexp_like(f, F.lit(f"^{POST_START}")))
    # columns of their own, so that they are made once for all fields that read them
    posts = posts.withColumns({"_text": content(f, TEXT_MARK), "_blocks": F.split(f, ACTION_MARK)})
    text, blocks = F.col("_text"), F.col("_blocks")
    return posts.select(
        *others,
        F.regexp_extract(f, ID_MARK, 1).alias("id"),
        F.regexp_extract(f, CREATOR_MARK, 1).alias("creator"),
        F.transform(F.regexp_extract_all(text, F.lit(TAG_MARK), 1), text_content).alias("hashtags"),
        post_timestamp(
            null_if_unknown(normal_post_time(F.regexp_extract(f, TIME_MARK, 1)), "")
        ).alias("ts"),
        counter(blocks, "retweet").alias("reshares"),
        counter(blocks, "favorite").alias("likes"),
        counter(blocks, "reply").alias("num_replies"),
        text_content(text).alias("text"),
        text_content(drop_anchors(text, greedy)).alias("clean_text"),
    )
