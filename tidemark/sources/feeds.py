"""Feeds and registries: raw documents to entries, registries, items, editions and labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import decode_entities, let, strip_html, trim
from tidemark.functions.urls import clean_url

REGISTRY = "id string, name string, lean string, wire boolean, url string, outlet string, topic string, note string"
ITEM = "source_id string, outlet string, lean string, wire boolean, topic_hint string, title string, description string, link string, published timestamp, categories array<string>"
COVERAGE = "source string, sourceId string, lean string, title string, url string"
STORY = f"""rank int, id string, topic string, topicLabel string, topicShort string, title string, summary string, url string, headlineSource string,
 summarySource string, publishedAt string, sourceCount int, leanCount int, leanSpread double, wireCount int, score double,
 scoreComponents struct<breadth double, diversity double, wire double, freshness double, softPenalty double>, coverage array<struct<{COVERAGE.replace(' string', ': string')}>>""".replace("breadth double, diversity double, wire double, freshness double, softPenalty double", "breadth: double, diversity: double, wire: double, freshness: double, softPenalty: double")  # fmt: skip


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """A JSON registry {sources: [...], leanWeights: {...}}: the sources in their order (feed_ix), and the weights."""
    whole = spark.read.option("multiLine", True).schema(f"sources array<struct<{REGISTRY.replace(' string', ': string').replace(' boolean', ': boolean')}>>, leanWeights map<string,int>").json(path)
    weights = whole.select("leanWeights").first()
    rows = whole.select(F.posexplode("sources").alias("feed_ix", "s")).select("feed_ix", "s.*")
    return rows, dict(weights[0] or {}) if weights else {}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed documents, one a file: source_id (the file's name) and xml. A whole feed is one small document."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return raw.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source_id"), F.col("value").alias("xml"))


def element(name: str) -> str:
    """A pattern of an element and, as group 1, its content, which goes from one < to the next."""
    return rf"(?i)<{name}(?:\s[^>]*+)?+>((?:[^<]++|<(?!/{name}>))*+)</{name}>"


def tag(xml: Column, *names: str) -> Column:
    """The content of the first of these tags, in the order of names, that isn't blank; CDATA unwrapped; else empty."""
    bare = lambda body: trim(F.when(body.rlike(r"(?s)<!\[CDATA\[.*?\]\]>"), F.regexp_extract(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)).otherwise(body))
    one = lambda name: let(let(F.regexp_extract(xml, element(rf"(?:\w+:)?{name}"), 1), bare), lambda x: F.when(x != "", x))
    return F.coalesce(*map(one, names), F.lit(""))


def atom_link(xml: Column) -> Column:
    """The href of the first link that is an alternate one or has no rel, else of the first that has a href."""
    attribute = lambda t, a: F.regexp_extract(t, rf"(?i)(?<!\w){a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    tags = F.regexp_extract_all(xml, F.lit(r"(?i)<(?:\w+:)?link\b([^>]*)/?>"), F.lit(1))
    links = F.filter(F.transform(tags, lambda t: F.struct(attribute(t, "href").alias("href"), attribute(t, "rel").alias("rel"))), lambda a: a["href"] != "")
    first = F.get(F.filter(links, lambda a: a["rel"].isin("", "alternate")), F.lit(0))
    return decode_entities(F.coalesce(first["href"], F.get(links, F.lit(0))["href"], F.lit("")))


def parse_date(text: Column) -> Column:
    """RFC 822 and ISO 8601 instants, with or without weekday, seconds and zone (UTC then); else null."""
    zones = {"(?:GMT|UTC?|Z)": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    bare = F.regexp_replace(trim(text), r"^[A-Za-z]{3,9},\s*", "")
    for name, offset in zones.items():
        bare = F.regexp_replace(bare, rf"(?i)(?<=[0-9\s]){name}$", offset)
    bare = F.regexp_replace(bare, r"([+-][0-9]{2}):([0-9]{2})$", "$1$2")
    bare = F.regexp_replace(bare, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)(?:\.[0-9]+)?\s*", "$1 $2 ")
    # Read many times below, so named.
    bare = let(bare, lambda b: F.when(b.rlike(r"[+-][0-9]{4}$") & b.contains(":"), b).when(b.contains(":"), F.concat(trim(b), F.lit(" +0000"))).otherwise(F.concat(b, F.lit(" 00:00 +0000"))))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s*([+-][0-9]{4})$", " $1"), r"\s+", " ")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd HH:mm Z"]
    return let(bare, lambda b: F.coalesce(*[F.try_to_timestamp(b, F.lit(f)) for f in forms]))


def parse_feeds(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """The entries of feed documents, RSS items before Atom entries: the other columns of raw, item_ix, title, link,
    description, published, categories. Entries without a title are left out; a broken block costs only itself."""
    others = [c for c in raw.columns if c != xml]
    blocks = lambda name: F.regexp_extract_all(F.col(xml), F.lit(element(name)), F.lit(1))
    each = raw.select(*others, F.posexplode(F.concat(blocks("item"), blocks("entry"))).alias("item_ix", "block"))
    b = F.col("block")
    bodies = F.regexp_extract_all(b, F.lit(element(r"(?:\w+:)?category")), F.lit(1))
    link = tag(b, "link", "guid", "id")
    out = each.select(
        *others, "item_ix",
        strip_html(tag(b, "title")).alias("title"),
        clean_url(let(link, lambda x: F.when(x != "", x).otherwise(atom_link(b)))).alias("link"),
        tag(b, "description", "summary", "subtitle", "encoded", "content").alias("description"),
        parse_date(tag(b, "pubDate", "published", "updated", "date", "created")).alias("published"),
        F.filter(F.transform(bodies, strip_html), lambda c: c != "").alias("categories"),
    )
    return out.where("title <> ''")


def with_registry(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries (source_id, ...) as items; unknown sources are their own outlet, of lean center and no wire.

    A registry is a list kept by hand, so it is small; Spark broadcasts it only while it is.
    """
    r = registry.select(F.col("id").alias("source_id"), F.col("outlet").alias("r_outlet"), F.col("lean").alias("r_lean"), F.col("wire").alias("r_wire"), F.col("topic").alias("r_topic"), F.col("name").alias("source_name"), "feed_ix")
    out = entries.join(r, "source_id", "left")
    return out.select(
        *[c for c in entries.columns if c != "categories"], F.coalesce("r_outlet", "source_id").alias("outlet"), F.coalesce("r_lean", F.lit("center")).alias("lean"), F.coalesce("r_wire", F.lit(False)).alias("wire"),
        F.col("r_topic").alias("topic_hint"), F.coalesce("source_name", "source_id").alias("source_name"), "feed_ix", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )


def read_fixture(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Items from a JSON array of them, in its order; no filter, dedupe or cap applies to them."""
    raw = spark.read.option("multiLine", True).schema("sourceId string, title string, description string, link string, published string, categories array<string>, event string").json(path)
    each = raw.withColumn("item_ix", F.monotonically_increasing_id()).select(F.col("sourceId").alias("source_id"), "item_ix", "title", F.coalesce("description", F.lit("")).alias("description"), "link", parse_date(F.col("published")).alias("published"), "categories", "event")
    return with_registry(each, registry)


def read_editions(spark: SparkSession, path: str, edition: str | None = None) -> DataFrame:
    """Stored editions; `latest` is the greatest name."""
    out = spark.read.option("multiLine", True).schema(f"version int, edition string, generatedAt string, timezone string, storyCount int, stories array<struct<{_nested(STORY)}>>").json(path)
    if edition == "latest":
        return out.where(F.col("edition") == out.agg(F.max("edition")).first()[0])
    return out if edition is None else out.where(F.col("edition") == edition)


def _nested(ddl: str) -> str:
    """Column definitions as fields of a struct."""
    out, depth = [], 0
    for part in ddl.replace("\n", " ").split(","):
        if depth == 0:
            name, kind = part.strip().split(" ", 1)
            part = f"{name}: {kind.strip()}"
        depth += part.count("<") - part.count(">")
        out.append(part.strip())
    return ", ".join(out)


def select_story(stories: DataFrame, wanted: str) -> DataFrame:
    """Of stories the one of that rank, if wanted is a number, else the first whose title holds it, in any case."""
    if wanted.strip().isdigit():
        return stories.where(F.col("rank") == int(wanted))
    return stories.where(F.lower("title").contains(wanted.lower())).orderBy("rank").limit(1)


CASE = f"id string, reported string, note string, limitation string, expect struct<topic: string, clusters: int, excluded: boolean, kept: boolean, headlineNot: string, summaryNot: string, headlineIndex: int, pairs: struct<merge: array<array<int>>, split: array<array<int>>>>, items array<struct<sourceId: string, {ITEM.replace('source_id string, ', '').replace('topic_hint', 'topicHint').replace(' array<', ': array<').replace(' string', ': string').replace(' boolean', ': boolean').replace(' timestamp', ': timestamp')}>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from {cases: [...]}, one row each."""
    return spark.read.option("multiLine", True).schema(f"cases array<struct<{_nested(CASE)}>>").json(path).select(F.explode("cases").alias("c")).select("c.*")


def probe_report(log: DataFrame) -> DataFrame:
    """Of a fetch log (source_id, lean, ok, items) the feeds that work (answered, with items), by lean."""
    works = F.col("ok") & (F.col("items") > 0)
    return log.groupBy("lean").agg(F.count_if(works).alias("working"), F.count(F.lit(1)).alias("feeds"), F.sum(F.when(works, F.col("items")).otherwise(0)).alias("items"))


def registry_balance(registry: DataFrame) -> DataFrame:
    """By topic (none: general) feeds, outlets, and how far left and right feeds are apart."""
    left, right = F.col("lean").isin("left", "center-left"), F.col("lean").isin("right", "center-right")
    return registry.groupBy(F.coalesce("topic", F.lit("general")).alias("topic")).agg(F.count(F.lit(1)).alias("feeds"), F.count_distinct(F.coalesce("outlet", "id")).alias("outlets"), F.abs(F.count_if(left) - F.count_if(right)).alias("tilt"))
