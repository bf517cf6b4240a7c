"""Topics: evidence of items, votes of outlets, the topic of a cluster, and the quota of each."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import let, matches, strip_html, trim
from tidemark.functions.urls import url_path

SPECIALIST = rules.SPECIALIST


def _firsts() -> tuple[str, str, int]:
    """Of the words that any keyword begins with the first letters and a pattern; and the most words of a keyword."""
    firsts, most = set(), 1
    for p in (p for ps in rules.KEYWORDS.values() for p in ps):
        body = re.fullmatch(r"(?:\(\?-i\))?\\b\(\?:(.*)\)\\b", p)[1]
        for one in re.findall(r"(?:\(\?:[^()]*\)|[^|()])+", body):
            firsts.add(re.match(r"[a-z]{2}[a-z?]*(?:\\w\*)?", one.lower())[0])
            most = max(most, 1 + one.count(" "))
    tree: dict[str, dict[str, list[str]]] = {}
    for w in sorted(firsts):
        tree.setdefault(w[0], {}).setdefault(w[1], []).append(w[2:])
    branch = lambda heads: "|".join(f"{h}(?:{'|'.join(tails)})" for h, tails in heads.items())
    return "".join(tree), branch({a: [branch(more)] for a, more in tree.items()}), most


INITIALS, FIRSTS, MOST_WORDS = _firsts()


def phrases(text: Column) -> Column:
    """What a plain text has in place of keywords: wherever a word begins one, it and the words after it, one a line.

    One scan for all topics; a keyword is in the text if and only if it is in this, which is mostly empty.
    """
    p = rf"(?i)(?=[{INITIALS}])(?<!\w)(?=(?:{FIRSTS})(?!\w))(?=(\w++(?: \w++){{0,{MOST_WORDS - 1}}}+))\w++"
    found = F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return F.array_join(F.array_distinct(found), "\n")


def keyword_hits(text: Column, topic: str) -> Column:
    """How many groups of the topic's words a plain text holds, or the phrases of one."""
    groups = lambda t: reduce(lambda a, b: a + b, [F.when(matches(t, p), 1).otherwise(0) for p in rules.KEYWORDS[topic]])
    return let(text, lambda t: F.when(t != "", groups(t)).otherwise(0))


def provenance(topic: str, hint: Column, path: Column, categories: Column) -> Column:
    """What says the topic before any word is read: the feed's hint, the section, the categories."""
    hinted = F.when(hint.isin([h for h, ts in rules.HINTS.items() if topic in ts]), rules.HINT_WEIGHT).otherwise(0.0)
    section = F.when(path.rlike("(?i)" + rules.TOPIC_SECTIONS[topic]), rules.SECTION_WEIGHT).otherwise(0.0)
    if topic in rules.HINTS["science"]:
        section = section + F.when(path.rlike("(?i)" + rules.SCIENCE_SECTIONS), rules.SECTION_WEIGHT).otherwise(0.0)
    named = F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: trim(c).rlike("(?i)^(?:" + "|".join(rules.TOPIC_CATEGORIES[topic]) + ")$"))
    return hinted + section + F.when(named, rules.CATEGORY_WEIGHT).otherwise(0.0)


def topic_evidence(items: DataFrame) -> DataFrame:
    """items (title, description, link, topic_hint, categories) with prov_, hits_ and score_ of each specialist topic."""
    out = items.withColumn("_text", phrases(F.concat_ws(" ", strip_html(F.col("title")), strip_html(F.col("description"))))).withColumn("_path", url_path(F.coalesce("link", F.lit(""))))
    for t in SPECIALIST:
        out = out.withColumn(f"prov_{t}", provenance(t, F.coalesce("topic_hint", F.lit("")), F.col("_path"), F.col("categories"))).withColumn(f"hits_{t}", keyword_hits(F.col("_text"), t))
    for t in SPECIALIST:
        out = out.withColumn(f"score_{t}", F.col(f"prov_{t}") + F.least(F.col(f"hits_{t}"), F.lit(rules.KEYWORD_CAP)))
    return out.drop("_text", "_path")


def outlet_key() -> Column:
    return F.coalesce("outlet", "source_id", "link", F.col("member_ix").cast("string"))


def topic_votes(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """By cluster: outlets, specialists (outlets that filed it under some topic), votes_ and support_ of each topic."""
    by_outlet = evidence.groupBy(*keys, outlet_key().alias("_outlet")).agg(*[F.max(F.col(f"prov_{t}") > 0).alias(f"v_{t}") for t in SPECIALIST], *[F.max(f"hits_{t}").alias(f"h_{t}") for t in SPECIALIST])
    some = reduce(lambda a, b: a | b, [F.col(f"v_{t}") for t in SPECIALIST])
    return by_outlet.groupBy(*keys).agg(F.count(F.lit(1)).alias("outlets"), F.count_if(some).alias("specialists"), *[F.count_if(f"v_{t}").alias(f"votes_{t}") for t in SPECIALIST], *[F.sum(f"h_{t}").alias(f"support_{t}") for t in SPECIALIST])


def coverage_topic() -> Column:
    """The topic that votes give a cluster: special only if special desks are most of it, or three and a third."""
    share = F.col("specialists") / F.col("outlets")
    claim = ((F.col("specialists") >= 2) | (F.col("specialists") == F.col("outlets"))) & ((share >= 0.5) | ((F.col("specialists") >= 3) & (share >= 0.34)))
    rank = {t: F.when(F.col(f"votes_{t}") > 0, F.col(f"votes_{t}") + F.least(F.col(f"support_{t}"), F.lit(6)) * F.lit(0.01)).otherwise(0.0) for t in SPECIALIST}
    high = F.greatest(*rank.values())
    named = reduce(lambda out, t: F.when((rank[t] == high) & (high > 0), t).otherwise(out), reversed(SPECIALIST), F.lit(rules.DEFAULT_TOPIC))
    return F.when(claim, named).otherwise(rules.DEFAULT_TOPIC)


def reconciled(topic: Column, headline: Column, hits: Column) -> Column:
    """The headline's own topic, if it alone leads among those voted for and the coverage's topic has no hit in it.

    hits: a struct of the headline's keyword hits by topic, a column of its own, as it is read many times.
    """
    own = reduce(lambda out, t: F.when(topic == t, hits[t]).otherwise(out), SPECIALIST, F.lit(0))
    open_ = {t: F.when(F.col(f"votes_{t}") > 0, hits[t]).otherwise(-1) for t in SPECIALIST}
    high = F.greatest(*open_.values())
    leaders = reduce(lambda a, b: a + b, [(open_[t] == high).cast("int") for t in SPECIALIST])
    best = reduce(lambda out, t: F.when(open_[t] == high, t).otherwise(out), SPECIALIST, topic)
    keep = (topic == rules.DEFAULT_TOPIC) | (F.coalesce(headline, F.lit("")) == "") | (own > 0) | (high <= 0) | (leaders > 1)
    return F.when(keep, topic).otherwise(best)


def explained(votes: DataFrame, headline: str = "headline") -> DataFrame:
    """votes joined with the headline: topic, coverage_topic, reconciled (what changed, or null), share."""
    heard = let(phrases(strip_html(F.col(headline))), lambda x: F.struct(*[keyword_hits(x, t).alias(t) for t in SPECIALIST]))
    out = votes.withColumns({"coverage_topic": coverage_topic(), "_hits": heard})
    out = out.withColumn("topic", reconciled(F.col("coverage_topic"), F.col(headline), F.col("_hits"))).drop("_hits")
    change = F.when(F.col("topic") != F.col("coverage_topic"), F.concat_ws(" ", "coverage_topic", F.lit("->"), "topic", F.lit("by headline")))
    return out.withColumn("reconciled", change).withColumn("specialist_share", F.floor(F.col("specialists") / F.col("outlets") * 100 + 0.5) / 100)


def quota_select(ranked: DataFrame, limit: int = 10, quotas: dict[str, int] = rules.QUOTAS, min_sources: int = 3, edition: str = "edition") -> DataFrame:
    """ranked (edition, topic, total, outlets_counted, tie order cluster_ix) to the chosen ones with rank.

    Topics are served in the order of quotas; special ones need min_sources outlets; free places go to the best of the
    rest. Ranks within a topic are limited first, so a topic with most clusters isn't sorted in one task.
    """
    order = [F.col("total").desc(), "cluster_ix"]
    table = F.create_map(*[F.lit(x) for k, (t, n) in enumerate(quotas.items()) for x in (t, F.struct(F.lit(k).alias("ord"), F.lit(n).alias("n")))])
    eligible = ((F.col("topic") == rules.DEFAULT_TOPIC) | (F.col("outlets_counted") >= min_sources)) & F.col("topic").isin(list(quotas))
    # No clusters but the first `limit` of a topic, eligible or not, can be chosen.
    best = ranked.withColumn("_e", eligible).withColumn("_k", F.row_number().over(Window.partitionBy(edition, "topic", "_e").orderBy(*order))).where(F.col("_k") <= limit)
    served = best.withColumn("_q", F.get(F.array(table[F.col("topic")]), F.lit(0)))
    served = served.withColumn("_in", F.col("_e") & (F.col("_k") <= F.col("_q.n")))
    served = served.withColumn("_turn", F.row_number().over(Window.partitionBy(edition).orderBy(F.col("_in").desc(), F.when(F.col("_in"), F.col("_q.ord")), F.when(F.col("_in"), F.col("_k")), *order)))
    chosen = served.where(F.col("_turn") <= limit)
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(edition).orderBy(*order))).drop("_e", "_k", "_q", "_in", "_turn")


def topic_report(stories: DataFrame) -> DataFrame:
    """By edition: stories of each topic, and whether one topic has them all."""
    counts = stories.groupBy("edition").agg(*[F.count_if(F.col("topic") == t).alias(t) for t in rules.TOPICS], F.count_distinct("topic").alias("topics"))
    return counts.withColumn("monoculture", F.col("topics") == 1)


def missed_specialists(clusters: DataFrame, chosen: DataFrame, titles: DataFrame, most: int = 6) -> DataFrame:
    """Special clusters none of whose titles was published (clusters, titles: edition, cluster_ix; chosen: edition,
    topic, title), the widest covered first."""
    special = clusters.where(F.col("topic") != rules.DEFAULT_TOPIC)
    shown = titles.join(chosen.where(F.col("topic") != rules.DEFAULT_TOPIC).select("edition", "title"), ["edition", "title"], "left_semi").select("edition", "cluster_ix").distinct()
    left = special.join(shown, ["edition", "cluster_ix"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("edition").orderBy(F.col("outlets").desc(), "cluster_ix"))).where(F.col("place") <= most)
