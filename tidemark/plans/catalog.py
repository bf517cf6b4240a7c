"""The registered queries, with an equivalent SQL text for each that has one (plans.oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions import text as T
from tidemark.functions.urls import clean_url, url_path
from tidemark.operators import delivery, filters, publish, rank, topics, vectors
from tidemark.operators.cluster import cluster_items
from tidemark.operators.evaluate import run_cases, triage
from tidemark.sources.saved import saved
from tidemark.plans import oracle
from tidemark.plans import samples as S
from tidemark.sources import feeds
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = oracle.SQL
ITEM_KEYS = ["edition", "item_id"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str | None = None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# --- text ------------------------------------------------------------------------------------------------------------


def _scalar(name: str, column) -> None:
    """Registers kind, id, value of a function of a text over all literals, documents, first lines of them (as titles) and pages."""
    f = lambda spark, sf_dir: S.texts(spark, sf_dir).select("kind", "id", column(F.col("text")).alias("value"))
    f.__name__ = name
    query(f)


_scalar("decode_entities", T.decode_entities)
_scalar("strip_html", T.strip_html)
_scalar("clean_description", T.clean_description)
_scalar("truncate_text", lambda c: T.truncate(c, 80))
_scalar("first_sentences", lambda c: T.first_sentences(c, 2, 260))
_scalar("without_quotes", T.without_quotes)
_scalar("title_case", lambda c: T.is_title_case(c))
_scalar("tokenize", lambda c: F.array_join(T.tokenize(c), " "))
_scalar("entities", lambda c: F.array_join(T.entities(c), "|"))
_scalar("sensationalism", T.sensationalism)
_scalar("opinion_score", lambda c: T.opinion_score(c).cast("int"))
_scalar("xml_escape", T.xml_escape)
_scalar("title_key", T.title_key)
_scalar("soft_news", rank.soft)


@query
def stem_words(spark, sf_dir):
    """Every distinct word of letters in the documents, with its stem."""
    words = S.table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query
def stable_id(spark, sf_dir):
    return S.items(spark, sf_dir).select("item_id", T.stable_id(F.col("title"), F.col("published")).alias("id"))


# --- addresses, feeds, registry --------------------------------------------------------------------------------------


@query
def clean_urls(spark, sf_dir):
    return S.urls(spark, sf_dir).select("kind", "id", clean_url(F.col("url")).alias("value"))


@query
def url_paths(spark, sf_dir):
    return S.urls(spark, sf_dir).select("kind", "id", url_path(F.col("url")).alias("value"))


@query
def percent_encoded(spark, sf_dir):
    return S.urls(spark, sf_dir).select("kind", "id", T.percent_encode(F.col("url")).alias("value"))


@query
def parse_dates(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(S.DATES)), "id long, text string").select("id", feeds.parse_date(F.col("text")).alias("at"))


@query
def parse_feeds(spark, sf_dir):
    """Each item as a feed document of its own, even ones RSS, odd ones Atom, read back."""
    i, x = S.items(spark, sf_dir), T.xml_escape
    link, at = F.coalesce("link", F.lit("")), F.coalesce(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    mail = F.coalesce(F.date_format("published", "EEE, d MMM yyyy HH:mm:ss 'GMT'"), F.lit(""))
    cats = F.array_join(F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.concat(F.lit("<category>"), c, F.lit("</category>"))), "")
    rss = F.concat(F.lit("<rss><channel><title>all</title><item><title><![CDATA["), x(F.col("title")), F.lit("]]></title><link>"), x(link), F.lit("</link><dc:description>"), x(F.col("description")), F.lit("</dc:description>"), cats, F.lit("<pubDate>"), mail, F.lit("</pubDate></item><item><title></title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed><entry a="1"><title type="html">'), x(F.col("title")), F.lit('</title><link rel="self" href="https://self.example.com/"/><link href="'), x(link), F.lit('"/><summary></summary><content>'), x(F.col("description")), F.lit("</content>"), cats, F.lit("<updated>"), at, F.lit("</updated></entry></feed>"))
    return feeds.parse_feeds(i.select("item_id", F.when(F.col("item_id") % 2 == 0, rss).otherwise(atom).alias("xml"))).select("item_id", "item_ix", "title", "link", "published", F.array_join("categories", "|").alias("categories"))


def _registry(spark, sf_dir) -> DataFrame:
    return S.items(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("source_name").alias("name"), "lean", "wire", "outlet", F.col("topic_hint").alias("topic"), "feed_ix").distinct()


@query
def registry_balance(spark, sf_dir):
    return feeds.registry_balance(_registry(spark, sf_dir))


@query
def registry_join(spark, sf_dir):
    """Items of odd feeds find their registry row; those of even feeds fall back."""
    known = _registry(spark, sf_dir).where("feed_ix % 2 = 1")
    entries = S.items(spark, sf_dir).select("item_id", "source_id", "categories")
    return feeds.with_registry(entries, known).select("item_id", "source_id", "outlet", "lean", "wire", "topic_hint", "source_name")


@query
def probe_report(spark, sf_dir):
    log = S.items(spark, sf_dir).groupBy("source_id", "lean", "feed_ix").agg(F.count(F.lit(1)).alias("items")).withColumn("ok", F.col("feed_ix") % 7 != 3)
    return feeds.probe_report(log)


# --- admission -------------------------------------------------------------------------------------------------------


@query
def newsworthy(spark, sf_dir):
    lit = S.headlines(spark).select(F.lit("literal").alias("kind"), "id", F.col("text").alias("title"), F.lit("https://example.org/a").alias("link"), F.array().cast("array<string>").alias("categories"))
    own = S.items(spark, sf_dir).select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "title", "link", "categories")
    return lit.unionByName(own).select("kind", "id", filters.newsworthy(F.col("title"), F.col("link"), F.col("categories")).alias("newsworthy"))


@query
def age_filter(spark, sf_dir):
    return S.items(spark, sf_dir).where(filters.fresh(F.col("published"), S.now(), 36)).select("item_id", "published")


def _admitted(spark, sf_dir) -> DataFrame:
    return filters.admitted(S.items(spark, sf_dir), S.now())


@query
def feed_admission(spark, sf_dir):
    """The daily build's items: filters, age, first of each title key, 30 a feed."""
    return _admitted(spark, sf_dir).select("item_id", "source_id", "title")


@query
def title_dedupe(spark, sf_dir):
    """The same without a cap or an age limit."""
    return filters.admitted(S.items(spark, sf_dir), S.now(), 1e6, 1 << 30).select("item_id", "source_id")


# --- vectors and clusters --------------------------------------------------------------------------------------------


def _weights(spark, sf_dir) -> DataFrame:
    # Read several times by what weighs terms and compares items.
    return saved(vectors.term_weights(saved(_admitted(spark, sf_dir)), ITEM_KEYS))


@query
def term_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select(*ITEM_KEYS, "term", r6("tf"), "proper")


@query
def idf(spark, sf_dir):
    return vectors.idf(_weights(spark, sf_dir), "edition", ITEM_KEYS).select("edition", "term", "df", r6("idf"))


@query
def unit_vectors(spark, sf_dir):
    return vectors.unit_vectors(_weights(spark, sf_dir), ITEM_KEYS).select(*ITEM_KEYS, "term", "proper", r6("w"))


@query
def pair_evidence(spark, sf_dir):
    """Admitted items of an edition: at most 30 a feed, so pairs are bounded by the registry."""
    v = vectors.unit_vectors(_weights(spark, sf_dir), ITEM_KEYS)
    out = vectors.pair_evidence(v, "edition", "item_id")
    return out.select("edition", "a", "b", *[r6(c) for c in ("cosine", "exclusive_a", "exclusive_b", "contested")], "shared", "predicate", F.round("ratio", 3).alias("ratio"))


@query
def cluster_assignments(spark, sf_dir):
    return cluster_items(_admitted(spark, sf_dir), item="item_id")


@query
def daily_build(spark, sf_dir):
    """Items to published stories of each edition: admission, vectors, clusters, scores, topics, quota, write-up."""
    # Admission reads every item, what it lets through is small: written once, as all later steps read it.
    admitted = saved(_admitted(spark, sf_dir))
    members = saved(admitted.join(cluster_items(admitted, item="item_id"), ITEM_KEYS))
    return rank.build_stories(members, S.now())


# --- scores, headlines, topics ---------------------------------------------------------------------------------------


@query
def unique_outlets(spark, sf_dir):
    return rank.unique_outlets(S.members(spark, sf_dir)).select("cluster_ix", "outlet", "member_ix")


@query
def lean_spread(spark, sf_dir):
    leans = rank.unique_outlets(S.members(spark, sf_dir)).groupBy("cluster_ix").agg(F.collect_list("lean").alias("leans"))
    return leans.select("cluster_ix", r6(rank.lean_spread(F.col("leans")), "lean_spread"), publish.lean_bar(F.col("leans")).alias("bar"))


@query
def score_components(spark, sf_dir):
    out = rank.score_clusters(S.members(spark, sf_dir), S.now())
    return out.select("cluster_ix", "outlets_counted", "leans", "wires", "newest", "members", *[r6(c) for c in ("lean_spread", "softness", "breadth", "diversity", "wire", "freshness", "soft_penalty", "total")])


@query
def consensus_rank(spark, sf_dir):
    """The ten clusters that most outlets of most leans carry."""
    scored = rank.score_clusters(S.members(spark, sf_dir), S.now()).select("cluster_ix", "outlets_counted", "leans", r6("total"))
    best = scored.orderBy(F.col("total").desc(), "cluster_ix").limit(10)
    return best.withColumn("rank", F.row_number().over(rank.Window.partitionBy(F.lit(1)).orderBy(F.col("total").desc(), "cluster_ix")))


def _marked(spark, sf_dir) -> DataFrame:
    u = rank.unique_outlets(S.members(spark, sf_dir))
    return rank.pick_headlines(u.withColumn("title_tokens", T.tokenize(F.col("title"))))


@query
def core_terms(spark, sf_dir):
    u = rank.unique_outlets(S.members(spark, sf_dir)).withColumn("title_tokens", T.tokenize(F.col("title")))
    return rank.core_terms(u).select("cluster_ix", F.array_join("core", " ").alias("core"))


@query
def headline_costs(spark, sf_dir):
    return _marked(spark, sf_dir).select("cluster_ix", "member_ix", r6("representative"), "sensational", r6("cost"), "is_headline")


@query
def summaries(spark, sf_dir):
    return rank.pick_summaries(_marked(spark, sf_dir)).select("cluster_ix", "summary", "summary_source")


@query
def coverage_list(spark, sf_dir):
    return rank.coverage(rank.unique_outlets(S.members(spark, sf_dir))).select("cluster_ix", F.posexplode("coverage").alias("place", "c")).select("cluster_ix", "place", "c.source", "c.sourceId", "c.lean", "c.title", "c.url")


def _evidence(spark, sf_dir) -> DataFrame:
    return topics.topic_evidence(S.members(spark, sf_dir))


@query
def topic_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("item_id", *[f"{k}_{t}" for t in rules.SPECIALIST for k in ("prov", "hits", "score")])


@query
def topic_literals(spark, sf_dir):
    """Keyword hits of the literal headlines, for words that the tables lack."""
    return S.headlines(spark).select("id", *[topics.keyword_hits(T.strip_html(F.col("text")), t).alias(f"hits_{t}") for t in rules.SPECIALIST])


def _votes(spark, sf_dir) -> DataFrame:
    return topics.topic_votes(_evidence(spark, sf_dir), rank.KEYS)


@query
def topic_votes(spark, sf_dir):
    return _votes(spark, sf_dir).drop("edition")


@query
def classify_clusters(spark, sf_dir):
    heads = S.headlines(spark).select(F.col("id").alias("cluster_ix"), F.col("text").alias("headline"))
    return topics.explained(_votes(spark, sf_dir).join(heads, "cluster_ix", "left")).select("cluster_ix", "coverage_topic", "topic", "reconciled", "specialist_share")


def _orders(spark, sf_dir) -> DataFrame:
    """Orders as clusters: editions are months, topics follow the priority."""
    named = F.get(F.array(*map(F.lit, ("world", "tech", "business", "health", "world"))), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return S.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("edition"), named.alias("topic"), F.col("o_totalprice").alias("total"), (F.col("o_custkey") % 6).cast("long").alias("outlets_counted"), F.col("o_orderkey").alias("cluster_ix"))


@query
def quota_select(spark, sf_dir):
    return topics.quota_select(_orders(spark, sf_dir), 10).select("edition", "rank", "cluster_ix", "topic", "total")


@query
def quota_select_seven(spark, sf_dir):
    return topics.quota_select(_orders(spark, sf_dir), 7, min_sources=5).select("edition", "rank", "cluster_ix", "topic", "total")


@query
def topic_report(spark, sf_dir):
    return topics.topic_report(S.stories(spark, sf_dir))


@query
def missed_specialists(spark, sf_dir):
    """Orders as clusters again; of each edition the seven chosen are what was published."""
    c = _orders(spark, sf_dir).withColumn("outlets", F.col("outlets_counted"))
    titles = c.select("edition", "cluster_ix", F.concat(F.lit("t"), "cluster_ix").alias("title"))
    chosen = topics.quota_select(c, 7).withColumn("title", F.concat(F.lit("t"), "cluster_ix"))
    return topics.missed_specialists(c, chosen, titles).select("edition", "place", "cluster_ix", "topic", "outlets")


# --- publishing and delivery -----------------------------------------------------------------------------------------


@query
def atom_entries(spark, sf_dir):
    return publish.atom_entries(S.stories(spark, sf_dir), "2024-01-30T00:00:00Z", "https://site.example.com/")


@query
def push_messages(spark, sf_dir):
    st = S.stories(spark, sf_dir)
    return publish.build_messages(st, "news", F.lit(10), limit=1 << 30, deliver_at=F.lit("2024-01-30 12:00:00").cast("timestamp"), now=S.now())


@query
def flag_urls(spark, sf_dir):
    return S.stories(spark, sf_dir).select("rank", publish.flag_url("example/example").alias("flag"))


@query
def edition_documents(spark, sf_dir):
    """One JSON document an edition, of the stories that the daily build chooses."""
    return publish.edition_json(daily_build(spark, sf_dir), S.now(), "America/Chicago")


@query
def delivery_plans(spark, sf_dir):
    """What would be delivered when, had a build ended at each event."""
    e = S.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    plan = delivery.delivery_plan(F.col("ts"), 6, 0, "America/Chicago", 180)
    return e.select("event_id", plan.alias("p"), delivery.local_date(F.col("ts"), "America/Chicago").alias("day")).select("event_id", "day", "p.action", "p.deliver_at", "p.late_minutes", "p.slot")


@query
def zone_slots(spark, sf_dir):
    """Six o'clock in Chicago on every day of a year, across both changes of the clock."""
    days = spark.range(366).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    slot = delivery.zoned_instant(F.col("day"), 6, 0, "America/Chicago")
    return days.select("day", slot.alias("slot"), delivery.zone_offset(slot, "America/Chicago").alias("zone_offset"))


# --- evaluation ------------------------------------------------------------------------------------------------------


@query
def triage_members(spark, sf_dir):
    return triage(S.members(spark, sf_dir)).select("cluster_ix", "member_ix", "admitted", "opinion", "sensational", "path", r6("representative"), "place")


@query
def labelled_cases(spark, sf_dir):
    """Three literal cases, judged before a background of literal headlines."""
    item = lambda t, hint=None: (None, "o1", "center", False, hint, t, "", "https://example.org/a", None, [])
    rows = [
        ("opinion", "", "", None, (None, None, True, None, None, None, None, None), [item(S.HEADLINES[4])]),
        ("kept", "", "", None, (None, 1, None, True, None, None, None, None), [item(S.HEADLINES[7])]),
        ("wrong", "", "", None, ("tech", None, None, None, None, None, None, None), [item(S.HEADLINES[17])]),
    ]
    cases = spark.createDataFrame(rows, feeds.CASE)
    back = S.headlines(spark).select(F.col("text").alias("title"), F.lit("").alias("description"))
    return run_cases(cases, back)


# --- streams ---------------------------------------------------------------------------------------------------------


@query
def stream_volume(spark, sf_dir):
    """Events through a file stream: counts by hour and type, read back once the stream has drained its input."""
    return ingest.drained(ingest.event_volume(ingest.stream_table(spark, sf_dir, "events")), "volume", ["hour", "event_type"])


@query
def stream_first_of_day(spark, sf_dir):
    """The first event that each user has of each type and day, exactly once, from a stream with state."""
    return ingest.drained(ingest.daily_firsts(ingest.stream_table(spark, sf_dir, "events")), "firsts", ["user_id", "event_type", "day"])
