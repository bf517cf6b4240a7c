"""Cases that the tables do not hold: values at edges, refusals, settings."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.urls import clean_url
from tidemark.operators import delivery, evaluate, publish
from tidemark.sources import feeds


def of(spark, function, *inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "k int, x string").select("k", function(F.col("x")).alias("y"))
    return [r["y"] for r in df.orderBy("k").collect()]


def test_texts(spark):
    assert of(spark, T.strip_html, "<b>a</b> &amp;lt; b", None, "x ( y ) , z", "caf&Eacute;") == ["a < b", "", "x (y), z", "café"]
    assert of(spark, lambda c: T.truncate(c, 10), "short", "a longer text", "unbrokenletters") == ["short", "a longer…", "unbrokenle…"]
    assert of(spark, lambda c: T.first_sentences(c, 1, 100), "The U.S. and 2.5 per cent. Then more.", "", None) == ["The U.S. and 2.5 per cent.", "", ""]
    assert of(spark, T.stem, "tariffs", "duties", "imported", "gas", "classes") == ["tariff", "duty", "import", "gas", "class"]
    assert of(spark, lambda c: T.tokenize(c), "The 12 and 123, 1234 well-known cafés") == [["1234", "well", "known", "caf"]]
    assert of(spark, clean_url, "http://A.com/x?utm_source=1&b=2#c", "mailto:x", None) == ["https://a.com/x?b=2", "", ""]


def test_feeds(spark):
    xml = "<rss><item><title>One &amp; only story</title><guid>https://a.com/1</guid><category>x</category></item><item><title>broken<item></rss><entry><title>Two</title><link rel='self' href='https://a.com/s'/><link href='https://a.com/2'/></entry>"
    got = feeds.parse_feeds(spark.createDataFrame([("f", xml), ("g", None), ("h", "no feed")], "source_id string, xml string")).orderBy("item_ix").collect()
    assert [(r["title"], r["link"]) for r in got][0] == ("One & only story", "https://a.com/1")
    assert ("Two", "https://a.com/2") in [(r["title"], r["link"]) for r in got]


def test_delivery_plan(spark):
    def plan(now):
        df = spark.createDataFrame([(now,)], "t string").select(delivery.delivery_plan(F.col("t").cast("timestamp"), 6, 0, "America/Chicago").alias("p"))
        return df.select("p.*").first()

    assert plan("2024-01-30 11:00:00")["action"] == "schedule"
    late = plan("2024-01-30 13:00:00")
    assert (late["action"], late["late_minutes"], late["deliver_at"]) == ("now", 60, datetime.datetime(2024, 1, 30, 13, 1))
    assert plan("2024-01-30 16:00:00")["action"] == "skip"


def test_refusals():
    with pytest.raises(ValueError):
        publish.check_publishable(4, 10, 10)
    with pytest.raises(ValueError):
        publish.check_publishable(9, 3, 10)
    publish.check_publishable(9, 3, 3)
    with pytest.raises(ValueError):
        evaluate.parse_verdict("nonsense=1")
    assert evaluate.parse_verdict("clusters=2") == {"clusters": 2} and evaluate.parse_verdict("kept") == {"kept": True}


def test_settings():
    c = publish.Config.read({"NTFY_TOPIC": " news ", "NTFY_HOUR": "", "NTFY_LIMIT": "abc", "NTFY_SERVER": "https://x/"})
    assert (c.topic, c.hour, c.limit, c.server) == ("news", 6, 10, "https://x")
