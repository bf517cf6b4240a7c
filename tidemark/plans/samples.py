"""Small literal inputs, invented here, for patterns that the large tables do not hold, and the mapping of the tables to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.saved import dealt

NOW = "2024-01-30 00:00:00"
LEANS = ["left", "center-left", "center", "center-right", "right"]
HINTS = [None, None, "tech", "business", "health", "science"]
CATEGORIES = [None, ["Business"], ["sport"], ["Technology", "x"], [" climate change "], ["Opinion"], []]

HEADLINES = [
    "Senate slams budget plan as chaos erupts in the capital!",
    "EXCLUSIVE: the secret memo that could topple a minister?",
    "Why the council must act before winter comes again",
    "We should be honest about the river and what it costs us",
    "Mayor is plain, old and wise about the harbour tunnel",
    "Here's why the harbour tunnel matters: what to know",
    "Watch live: rocket launch carries satellite to orbit",
    "Central bank holds interest rates as inflation slows in the region",
    "Hospital trial of cancer vaccine finds patients live longer",
    "AI model from chipmaker beats large language model on open source tests",
    "Ai Lin paints wildfire and drought across four walls of the museum",
    "Storm crushes coastal town, and 'we are annihilated' says its mayor",
    "Governor “obliterated” the bill, aides say",
    "Prince Harry and a duchess walk the red carpet at film gala",
    "In pictures: the week in the garden",
    "Guest post: how rivers move their banks",
    "My year without a telephone and what it taught me",
    "Ten die as ferry sinks off Chile; rescue goes on",
    "U.S. envoy meets Lt. Col. Marsh in St. Ives. Talks end at 20.8 per cent. No deal was signed",
    "Premier, 71, to leave office in may",
    "The Bank of England and the Royal Society of Arts Share New Building in London",
    "FTSE closes lower as NATO ministers meet EU leaders in Rome",
    "Fish &amp; chips: caf&eacute; owners &#8216;relieved&#8217; &#x1F600; &amp;amp; happy &unknown; &#0; &#xD800;",
    "<p>Dams <b>fill</b> after <br/>rain &mdash; at last &hellip;</p><script>x('</p>')</script>",
    "Flood report ( draft ) was late , says board ; it 's out now !",
    "Rail strike ends. Read more…",
    "By Ann Lee | Rail strike ends after nine days. Continue reading on our site",
    "(Reuters) - Oil prices rose on Monday. Sign up for our letter",
    "The post Rail strike ends appeared first on Daily Rail.",
    "Photo: A bridge. Subscribe to us. Click here",
    "\") The quote was cut here, said the editor. \"Not all of it was",
    "(An aside that never closes. And then another one begins (and ends) here. Third",
    "What comes next? Nobody knows! Visit example.com for more. Plan B. It failed",
    "Short",
    "",
    "ties studies classes glasses bus analysis running planned hoping used imposed tariff tariffs 12 123 1234 well-known it's",
    "A very long headline that goes on and on about the weather in the northern part of the country, the trains, the roads and all else besides",
    "Ministers: a reply is due",
]

URLS = [
    "http://News.Example.com/Opinion/a-b?utm_source=x&id=7&ref=y#top", "https://example.org/tech/ai/chips?ito=1", "https://example.org", "https://example.org?x=1&&y=2&UTM_medium=z",
    "ftp://example.org/file", "not a url", "", "https://example.net/science/heart?SMID=3&q=a%20b", "https://example.net/business/markets/?ns_x=1&at_y=2&keep=%3D&amp;z=1", "  https://example.com/sport/football/goal  ",
    "https://example.com/blog/analysis/why?sh=1&shop=2&source=rss#x", "HTTPS://EXAMPLE.COM/climate-news/item",
]

DATES = ["Tue, 30 Jan 2024 06:05:04 GMT", "30 Jan 2024 06:05 +0200", "2024-01-30T06:05:04Z", "2024-01-30T06:05:04.123+01:00", "2024-01-30", "2024-01-30 06:05:04", "yesterday", "", "Mon, 1 Jul 2024 23:59:59 EST"]
#: What DATES say, in UTC.
INSTANTS = ["2024-01-30 06:05:04", "2024-01-30 04:05:00", "2024-01-30 06:05:04", "2024-01-30 05:05:04", "2024-01-30 00:00:00", "2024-01-30 06:05:04", None, None, "2024-07-02 04:59:59"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items: the number in the source gives outlet, lean, wire and hint; the first line is the title."""
    d = dealt(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("source_id"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("feed_ix"))
    p = dealt(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("item_id"), F.col("url").alias("link"))
    o = F.col("feed_ix") % 14
    pick = lambda values, k: F.get(F.array(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for v in values]), k)
    published = F.when(F.col("item_id") % 17 != 0, F.timestamp_micros(F.unix_micros(now()) - (F.col("item_id") % 72) * 3_600_000_000))
    title = F.substring_index("text", "\n", 1)
    out = d.join(p, "item_id", "left").withColumn("title", title).withColumn("published", published)
    return out.select(
        "item_id", F.col("item_id").alias("item_ix"), "source_id", "feed_ix", F.concat(F.lit("Feed "), "source_id").alias("source_name"), F.concat(F.lit("o"), o.cast("string")).alias("outlet"),
        pick(LEANS, o % 5).alias("lean"), (o % 3 == 0).alias("wire"), pick(HINTS, F.col("feed_ix") % 6).alias("topic_hint"), "title", F.expr("substring(text, length(title) + 2)").alias("description"),
        "link", "published", pick(CATEGORIES, (F.col("item_id") % 7).cast("int")).alias("categories"), F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit(NOW[:10])).alias("edition"),
    )


def headlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HEADLINES)), "id long, text string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, text: the literal headlines, documents, their first lines as titles, and the markup of pages."""
    whole = dealt(table(spark, sf_dir, "documents")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    d = dealt(table(spark, sf_dir, "documents")).select(F.lit("title").alias("kind"), F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("text"))
    p = dealt(table(spark, sf_dir, "pages")).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return headlines(spark).select(F.lit("literal").alias("kind"), "id", "text").unionByName(d).unionByName(whole).unionByName(p)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dealt(table(spark, sf_dir, "pages")).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    return spark.createDataFrame(list(enumerate(URLS)), "id long, url string").select(F.lit("literal").alias("kind"), "id", "url").unionByName(p)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items in 97 clusters of one edition, by their number."""
    return items(spark, sf_dir).drop("edition").withColumns({"edition": F.lit(NOW[:10]), "cluster_ix": F.col("item_id") % 97, "member_ix": F.col("item_id")})


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as if it were a story."""
    topic = F.get(F.array(*map(F.lit, ("world", "tech", "business", "health"))), (F.col("item_id") % 4).cast("int"))
    short = F.when(F.col("item_id") % 5 != 0, F.upper(topic))
    cover = F.struct(F.col("source_name").alias("source"), F.col("source_id").alias("sourceId"), "lean", "title", F.col("link").alias("url"))
    return items(spark, sf_dir).select(
        "edition", (F.col("item_id") + 1).cast("int").alias("rank"), F.concat(F.lit("s"), "item_id").alias("id"), topic.alias("topic"), F.initcap(topic).alias("topicLabel"), short.alias("topicShort"),
        "title", F.when(F.col("item_id") % 3 != 0, F.col("description")).alias("summary"), F.col("link").alias("url"), F.col("source_name").alias("headlineSource"),
        (F.col("item_id") % 5 + 1).cast("int").alias("sourceCount"), (F.col("item_id") % 3 + 1).cast("int").alias("leanCount"), F.when(F.col("item_id") % 4 == 0, F.array().cast("array<struct<source:string,sourceId:string,lean:string,title:string,url:string>>")).otherwise(F.array(cover)).alias("coverage"),
    )
