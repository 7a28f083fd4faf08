"""RSS feeds and alert mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, strip
from ..functions.text import matched_title


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Feed items; files split by item, so one long feed is read by many tasks."""
    shape = "link string, title string, pubDate string, guid string"
    raw = spark.read.format("xml").option("rowTag", "item").schema(shape).load(path)
    return parse_items(raw)


def parse_items(items: DataFrame) -> DataFrame:
    link = strip(F.coalesce("link", F.lit("")))
    rows = items.filter(link != "")
    return rows.select(
        link.alias("link"), strip(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce(blank_to_null("guid"), link).alias("guid"), feed_date("pubDate").alias("filed_at"),
    )


def feed_date(value: Column | str) -> Column:
    """The calendar day of an RFC-822 date as written, in the feed's own offset."""
    text = F.regexp_replace(strip(value), r"^[A-Za-z]{3},?\s*", "")
    parts = F.regexp_extract(text, r"^(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})\s+\d{1,2}:\d{2}", 1)
    return F.try_to_date(F.regexp_replace(parts, r"\s+", " "), "d MMM yyyy")


def on_topic(items: DataFrame) -> DataFrame:
    return items.withColumn("on_topic", matched_title("title"))


def topic_counts(items: DataFrame) -> DataFrame:
    return on_topic(items).groupBy("on_topic").agg(F.count("*").alias("n"))


def mail_link(subject: Column | str, text: Column | str, html: Column | str, preferred: str = "sedar") -> Column:
    """The filing link of an alert mail: the first naming the archive, else the first of all."""
    blob = F.concat_ws("\n", subject, text, html)
    found = F.transform(F.regexp_extract_all(blob, F.lit(r'(https?://[^\s<>"]+)'), F.lit(1)), lambda u: F.regexp_replace(u, r"[).,]+$", ""))
    named = F.filter(found, lambda u: F.lower(u).contains(preferred))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(found, F.lit(1)))
