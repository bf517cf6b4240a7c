"""What is admitted: newsworthiness, age, repeats and a cap for each feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import matches, opinion_score, strip_html, title_key, trim
from tidemark.functions.urls import url_path


def excluded_section(path: Column) -> Column:
    return path.rlike("(?i)/(?:" + "|".join(rules.EXCLUDED_SECTIONS) + ")/")


def opinion_section(path: Column) -> Column:
    return path.rlike("(?i)/(?:" + "|".join(rules.OPINION_SECTIONS) + ")/")


def excluded_title(title: Column) -> Column:
    return reduce(lambda a, b: a | b, [matches(title, p) for p in rules.EXCLUDED_TITLES])


def excluded_category(categories: Column) -> Column:
    return F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: trim(c).rlike("(?i)^(?:" + "|".join(rules.EXCLUDED_CATEGORIES) + ")$"))


def looks_like_opinion(title: Column) -> Column:
    return opinion_score(title) >= rules.OPINION_NEEDED


def newsworthy(title: Column, link: Column, categories: Column) -> Column:
    """False for short titles, sections, titles and categories that carry no reporting, and opinion; never null."""
    path = url_path(link)
    bad = excluded_section(path) | opinion_section(path) | excluded_category(categories) | (F.length(strip_html(title)) < 15) | excluded_title(title) | looks_like_opinion(title)
    return F.coalesce((title != "") & ~bad, F.lit(False))


def fresh(published: Column, now: Column, hours: float = 36) -> Column:
    """Undated items and those of the future pass."""
    return published.isNull() | (published >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0)))


def admitted(items: DataFrame, now: Column, hours: float = 36, per_feed: int = 30) -> DataFrame:
    """items (source_id, item_ix, title, link, published, categories, ...) that pass, the first of each title key of a
    feed, and of those the first per_feed of the feed, in the order of item_ix."""
    passing = items.where((F.coalesce("link", F.lit("")) != "") & newsworthy(F.col("title"), F.col("link"), F.col("categories")) & fresh(F.col("published"), now, hours))
    keyed = passing.withColumn("_key", title_key(F.col("title")))
    first = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("source_id", "_key").orderBy("item_ix"))).where("_k = 1").drop("_k", "_key")
    few = first.withColumn("_k", F.row_number().over(Window.partitionBy("source_id").orderBy("item_ix"))).where(F.col("_k") <= per_feed).drop("_k")
    return few.withColumn("title", strip_html(F.col("title"))).withColumn("description", F.coalesce("description", F.lit("")))
