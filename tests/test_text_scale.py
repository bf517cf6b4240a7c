"""Texts as long and as many as large tables have: what a text function costs, against one scan by a plain pattern."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import topics
from tidemark.sources import feeds
from tests.test_operators import of

PROSE = "The council of Ministers met on Monday, and said that rivers 'will not wait' for another studies; the Harbour tunnel needed\nmore time. Prices in St. Ives rose by 2.5 per cent (they said) – it ’s the “plainest” of all reasons to keep on walking home.\n"
PAGE = "<p>" + PROSE.replace(".", ".&nbsp;<br/>").replace("\n", "\n<p class='a'>") + "</p>"


@pytest.fixture(scope="module")
def long_texts(spark):
    df = spark.range(0, 96, 1, 4).select(F.repeat(F.lit(PROSE), 160).alias("x"), F.repeat(F.lit(PAGE), 60).alias("page"))
    df = df.select("*", F.concat(F.lit("<rss><item><title>t</title><link>https://a.com/1</link><description>"), F.col("x"), F.lit("</description><category>c</category><pubDate>Tue, 30 Jan 2024 06:05:04 GMT</pubDate></item></rss>")).alias("xml")).cache()
    df.count()
    return df


def seconds(df) -> float:
    took = []
    for _ in range(3):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    return min(took)


def words(x):
    return F.size(F.split(x, "[^a-z0-9]+"))


def evidence(df):
    rows = df.select(F.lit("t").alias("title"), F.col("x").alias("description"), F.lit("").alias("link"), F.lit("").alias("topic_hint"), F.array().cast("array<string>").alias("categories"))
    return topics.topic_evidence(rows).select(*[f"score_{t}" for t in topics.SPECIALIST])


#: Scans that each may cost: between what was measured before and after.
COSTS = {
    "strip_html": (lambda df: df.select(T.strip_html(F.col("x"))), 7.0),  # 11.2 before, 4.3 after
    "pages": (lambda df: df.select(T.strip_html(F.col("page"))), 3.6),  # 5.9, 2.2
    "clean_description": (lambda df: df.select(T.clean_description(F.col("x"))), 7.6),  # 15.2, 3.8
    "first_sentences": (lambda df: df.select(T.first_sentences(F.col("x"), 2, 260)), 2.2),  # 6.1, 0.8
    "tokenize": (lambda df: df.select(T.tokenize(F.col("x"))), 10.0),  # 16.8, 5.9
    "title_case": (lambda df: df.select(T.is_title_case(F.col("x"))), 10.0),  # 18.5, 5.7
    "entities": (lambda df: df.select(T.entities(F.col("x"))), 11.0),  # 20.1, 6.1
    "opinion_score": (lambda df: df.select(T.opinion_score(F.col("x"))), 7.0),  # 10.4, 4.6
    "topic_evidence": (evidence, 10.0),  # 19.6, 5.0
}


@pytest.mark.parametrize("name", COSTS)
def test_cost_in_scans(long_texts, name):
    make, most = COSTS[name]
    scan = long_texts.select(words(F.col("x")))
    assert seconds(make(long_texts)) < most * max(seconds(scan), seconds(scan))


def test_spaces_before_a_last_mark_of_unicode_stay(spark):
    # As in SQL: an end is the end of the text, not the place before a last line mark.
    assert of(spark, T.strip_html, "x \x85", "a\xa0 b　 c\t") == ["x \x85", "a b c"]
    assert of(spark, T.trim, "x \x85", " x﻿", None) == ["x \x85", "x", None]


def test_entities_of_a_long_run(spark):
    names = "Ann " * 60000
    assert of(spark, T.entities, "x. " + "it is so " * 40000 + names + "end")[0][-1] == "ann"


def test_first_sentences_of_a_long_word(spark):
    # Quadratic before: each place in the word was tried as a beginning.
    t = time.perf_counter()
    assert of(spark, lambda c: T.first_sentences(c, 2, 260), "a" * 400000 + ".b ends. " + "Then comes more. " * 3) == ["b ends. Then comes more."]
    assert time.perf_counter() - t < 30


def test_tokens_are_stems_of_words(spark):
    texts = ["exceeding ties studies glasses classes boxes buses analysis being ringing need needed used house series sses gas 12 123 1234 a1b2ies"]
    kept = [w for w in texts[0].split() if len(w) >= 3 and w not in T.rules.STOPWORDS and not (len(w) == 3 and w.isdigit())]
    assert of(spark, T.tokenize, *texts)[0] == of(spark, T.stem, *kept)


def test_phrases_hold_all_keywords(spark):
    text = "AI and air. Tech company stock market, large language model wall street; climate change crisis, gene-genome cells aid nanometres"
    plain = [of(spark, lambda c: topics.keyword_hits(c, t), text) for t in topics.SPECIALIST]
    assert [of(spark, lambda c: topics.keyword_hits(topics.phrases(c), t), text) for t in topics.SPECIALIST] == plain
    assert of(spark, topics.phrases, "Nothing of this is said in plain air", "") == ["", ""]


def test_every_boilerplate_sign_is_in_its_match(spark):
    said = ["One. Continue reading here", "One. READ MORE: ", "One. The post x appeared first on y", "One […]", "One appeared first on x", "by Ann Lee | One", "One click here now", "One subscribe to us", "One. Sign up for all", "One photo: x", "(AFP) - One"]
    assert [x.strip(" .") for x in of(spark, T.clean_description, *said)] == ["One"] * len(said)


def test_feed_with_marks_inside(spark):
    xml = "<rss><item><title>a <b>b</b> &lt;c&gt;</title><link>https://a.com/1</link><category>x < y</category><pubDate>30 Jan 2024 06:05 +0200</pubDate></item><item><title>open</item></rss>"
    got = feeds.parse_feeds(spark.createDataFrame([("f", xml)], "source_id string, xml string")).collect()
    assert [(r["title"], r["link"], r["categories"], str(r["published"])) for r in got] == [("a b", "https://a.com/1", ["x < y"], "2024-01-30 04:05:00")]
