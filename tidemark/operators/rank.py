"""Scores of clusters by the outlets that carry them, their headline, summary and coverage, and the chosen stories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import clean_description, first_sentences, let, matches, opinion_score, sensationalism, stable_id, tokenize, truncate
from tidemark.operators import topics

KEYS = ["edition", "cluster_ix"]
WIRE_BONUS, COMMON_WEIGHT, CORE_SHARE, SUMMARY_OVERLAP = 1.25, 5.0, 0.4, 0.2


def two_places(x: Column) -> Column:
    """Rounded to hundredths, halves upward, without a negative zero."""
    return F.floor(x * 100 + F.lit(0.5)) / 100 + F.lit(0.0)


def soft(title: Column) -> Column:
    return reduce(lambda a, b: a | b, [matches(F.coalesce(title, F.lit("")), p) for p in rules.SOFT_NEWS])


def unique_outlets(members: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The first member of each outlet of a cluster."""
    w = Window.partitionBy(*keys, "outlet").orderBy("member_ix")
    return members.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def lean_spread(leans: Column, weights: dict[str, int] = rules.LEAN_WEIGHTS) -> Column:
    """How far the leans (an array, one for each outlet) are apart, as a share of the whole range."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    values = F.transform(leans, lambda x: F.coalesce(F.try_element_at(table, F.coalesce(x, F.lit(""))), F.lit(0)))
    whole = max(weights.values()) - min(weights.values())
    return F.when((F.size(leans) >= 2) & F.lit(whole > 0), (F.array_max(values) - F.array_min(values)) / F.lit(float(whole or 1))).otherwise(0.0)


def score_clusters(members: DataFrame, now: Column, keys: list[str] = KEYS, weights: dict[str, int] = rules.LEAN_WEIGHTS) -> DataFrame:
    """keys, total and what makes it up. members: keys, member_ix, outlet, lean, wire, title, published.

    Of each outlet its first member counts; softness and age look at all members. A cluster's rows are summed by
    outlet first, so a cluster with most members isn't gathered.
    """
    m = members.withColumn("_lean", F.coalesce("lean", F.lit("?")))
    firsts = F.min_by(F.struct("_lean", F.coalesce("wire", F.lit(False)).alias("wire")), "member_ix")
    by_outlet = m.groupBy(*keys, "outlet").agg(firsts.alias("one"), F.max("published").alias("newest"), F.count_if(soft(F.col("title"))).alias("soft"), F.count(F.lit(1)).alias("n"))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    value = F.coalesce(F.try_element_at(table, F.col("one._lean")), F.lit(0))
    whole = float(max(weights.values()) - min(weights.values())) or 1.0
    out = by_outlet.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outlets_counted"),
        F.count_distinct("one._lean").alias("leans"),
        F.when(F.count(F.lit(1)) >= 2, (F.max(value) - F.min(value)) / F.lit(whole)).otherwise(0.0).alias("lean_spread"),
        F.count_if("one.wire").alias("wires"),
        F.max("newest").alias("newest"),
        (F.sum("soft") / F.sum("n")).alias("softness"),
        F.sum("n").alias("members"),
    )
    age = F.when(F.col("newest").isNull(), 24.0).otherwise(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("newest")) / 3.6e9))
    out = out.withColumn("breadth", 3.0 * F.log2(F.lit(1.0) + F.col("outlets_counted"))).withColumn("diversity", 1.4 * (F.col("leans") - 1) + 2.2 * F.col("lean_spread"))
    out = out.withColumn("wire", 0.8 * F.least("wires", F.lit(4))).withColumn("freshness", 2.5 * F.pow(F.lit(0.5), age / 18.0)).withColumn("soft_penalty", -6.0 * F.col("softness") + F.lit(0.0))
    return out.withColumn("total", F.col("breadth") + F.col("diversity") + F.col("wire") + F.col("freshness") + F.col("soft_penalty"))


def core_terms(members: DataFrame, keys: list[str] = KEYS, share: float = CORE_SHARE) -> DataFrame:
    """keys, core: the terms in at least two, and that share, of the titles of members (title_tokens)."""
    size = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = members.select(*keys, F.explode(F.array_distinct("title_tokens")).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("c"))
    core = counts.join(size, keys).where(F.col("c") >= F.greatest(F.lit(2), F.ceil(F.col("n") * share))).groupBy(*keys).agg(F.sort_array(F.collect_list("term")).alias("core"))
    return size.join(core, keys, "left").select(*keys, F.coalesce("core", F.array().cast("array<string>")).alias("core"))


def representativeness(tokens: Column, core: Column) -> Column:
    """The share of core that tokens hold; one if there is no core."""
    return F.when(F.size(core) == 0, 1.0).otherwise(F.size(F.array_intersect(tokens, core)) / F.size(core))


def pick_headlines(unique: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """unique (one member an outlet; title_tokens) with core, representative, sensational, cost and is_headline."""
    out = unique.join(core_terms(unique, keys), keys)
    out = out.withColumn("representative", representativeness(F.col("title_tokens"), F.col("core"))).withColumn("sensational", sensationalism(F.col("title")))
    out = out.withColumn("cost", F.col("sensational") - F.when(F.col("wire"), WIRE_BONUS).otherwise(0.0) - COMMON_WEIGHT * F.col("representative"))
    w = Window.partitionBy(*keys).orderBy("cost", F.length("title"), "member_ix")
    return out.withColumn("is_headline", F.row_number().over(w) == 1)


def pick_summaries(marked: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """marked (pick_headlines) to keys, summary, summary_source (null if the fallback spoke).

    The cheapest description of sixty letters or more that is about the headline's subject; none if even that shares
    less than a fifth of the core. Then the first of forty letters or more, the headline's own before others.
    """
    heads = marked.where("is_headline").select(*keys, F.array_distinct("title_tokens").alias("head_tokens"))
    out = marked.join(heads, keys).withColumn("clean", clean_description(F.col("description")))
    out = out.withColumn("both", F.array_distinct(tokenize(F.concat_ws(" ", "title", "clean")))).withColumn("about", F.when(F.size("core") > 0, F.col("core")).otherwise(F.col("head_tokens")))
    relates = (F.size("head_tokens") == 0) | (F.size(F.array_intersect("both", "head_tokens")) / F.greatest(F.size("head_tokens"), F.lit(1)) >= SUMMARY_OVERLAP)
    rep = representativeness(F.col("both"), F.col("about"))
    out = out.withColumn("rep", rep).withColumn("able", (F.length("clean") >= 60) & relates)
    price = F.when(F.col("wire"), -2.0).otherwise(0.0) + sensationalism(F.col("clean")) * 0.5 + opinion_score(F.col("clean")) * 1.5 + F.when(F.col("is_headline"), 0.75).otherwise(0.0) - COMMON_WEIGHT * F.col("rep")
    out = out.withColumn("price", price)
    best = F.min_by(F.when(F.col("able"), F.struct("clean", "source_id", "rep")), F.when(F.col("able"), F.struct("price", "member_ix")))
    spare = F.min_by(F.when(F.length("clean") >= 40, F.col("clean")), F.when(F.length("clean") >= 40, F.struct(~F.col("is_headline"), "member_ix")))
    one = out.groupBy(*keys).agg(best.alias("best"), spare.alias("spare"))
    good = F.col("best").isNotNull() & (F.col("best.rep") >= SUMMARY_OVERLAP)
    text = let(F.when(good, F.col("best.clean")).otherwise(""), lambda t: first_sentences(t, 2, 260))
    one = one.withColumn("chosen", text)
    return one.select(*keys, F.when(F.col("chosen") != "", F.col("chosen")).when(F.col("spare").isNotNull(), truncate(F.col("spare"), 260)).otherwise("").alias("summary"), F.when(good, F.col("best.source_id")).alias("summary_source"))


def coverage(unique: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, coverage: the outlets' items by source name (as people sort them), then member."""
    row = F.struct(F.collate("source_name", "UNICODE").alias("k"), F.col("member_ix"), F.struct(F.col("source_name").alias("source"), F.col("source_id").alias("sourceId"), "lean", truncate(F.col("title"), 180).alias("title"), F.col("link").alias("url")).alias("c"))
    return unique.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["c"]).alias("coverage"))


def build_stories(members: DataFrame, now: Column, limit: int = 10, quotas: dict[str, int] = rules.QUOTAS, min_sources: int = 3) -> DataFrame:
    """The published stories of each edition.

    members: edition, cluster_ix, member_ix, source_id, source_name, outlet, lean, wire, topic_hint, title,
    description, link, published, categories.
    """
    m = members.withColumn("title_tokens", tokenize(F.col("title"))).withColumn("wire", F.coalesce("wire", F.lit(False)))
    marked = pick_headlines(unique_outlets(m))
    heads = marked.where("is_headline").select(*KEYS, F.col("title").alias("headline"), F.col("link").alias("url"), F.col("source_name").alias("headline_source"))
    votes = topics.topic_votes(topics.topic_evidence(m), KEYS)
    scored = score_clusters(m, now).join(heads, KEYS).join(votes, KEYS)
    chosen = topics.quota_select(topics.explained(scored), limit, quotas, min_sources)
    # Only chosen clusters are written up: a few rows by edition.
    of = marked.join(chosen.select(*KEYS), KEYS, "left_semi")
    named = members.select("source_id", "source_name").distinct().withColumnsRenamed({"source_id": "summary_source", "source_name": "summary_source_name"})
    text = pick_summaries(of).join(named, "summary_source", "left")
    out = chosen.join(text, KEYS).join(coverage(of), KEYS)
    label = lambda k: F.create_map(*[F.lit(x) for t, v in rules.TOPICS.items() for x in (t, v[k])])[F.col("topic")]
    return out.select(
        "edition", "rank", stable_id(F.col("headline"), F.col("newest")).alias("id"), "topic", label(0).alias("topicLabel"), label(1).alias("topicShort"), truncate(F.col("headline"), 180).alias("title"), "summary", "url",
        F.col("headline_source").alias("headlineSource"), F.col("summary_source_name").alias("summarySource"), F.date_format("newest", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("publishedAt"),
        F.col("outlets_counted").cast("int").alias("sourceCount"), F.col("leans").cast("int").alias("leanCount"), two_places(F.col("lean_spread")).alias("leanSpread"), F.col("wires").cast("int").alias("wireCount"), two_places(F.col("total")).alias("score"),
        F.struct(*[two_places(F.col(a)).alias(b) for a, b in (("breadth", "breadth"), ("diversity", "diversity"), ("wire", "wire"), ("freshness", "freshness"), ("soft_penalty", "softPenalty"))]).alias("scoreComponents"),
        "coverage", "cluster_ix", "coverage_topic", "reconciled", "outlets", "specialists", "specialist_share", *[f"votes_{t}" for t in rules.SPECIALIST],
    )
