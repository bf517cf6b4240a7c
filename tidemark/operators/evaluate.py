"""Labelled cases: what should have been dropped, kept, merged, split or labelled otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import opinion_score, sensationalism, tokenize
from tidemark.functions.urls import url_path
from tidemark.operators import rank, topics
from tidemark.operators.cluster import cluster_items
from tidemark.operators.filters import newsworthy

VERDICTS = {"excluded": bool, "kept": bool, "topic": str, "clusters": int, "headlineIndex": int, "headlineNot": str, "summaryNot": str}


def parse_verdict(text: str) -> dict:
    """A verdict `name=value` (a bare name is true) as {name: value} of its type; unknown names are refused."""
    name, _, value = text.partition("=")
    if name not in VERDICTS:
        raise ValueError(f"unknown verdict {name!r}; known: {', '.join(VERDICTS)}")
    kind = VERDICTS[name]
    return {name: value in ("", "true", "yes") if kind is bool else kind(value)}


def append_case(cases: DataFrame, case: DataFrame) -> DataFrame:
    """cases with one more; its id must be new."""
    if case.join(cases, "id", "left_semi").limit(1).count():
        raise ValueError("a case of that id exists")
    return cases.unionByName(case, allowMissingColumns=True)


def case_items(cases: DataFrame) -> DataFrame:
    """id, position, the item's columns, admitted (by the filters, or all where the case expects exclusion), news."""
    each = cases.select("id", "expect", F.posexplode("items").alias("position", "i"))
    out = each.select("id", "expect", "position", F.col("i.sourceId").alias("source_id"), F.coalesce("i.outlet", "i.sourceId").alias("outlet"), "i.lean", F.coalesce("i.wire", F.lit(False)).alias("wire"), F.col("i.topicHint").alias("topic_hint"), "i.title", "i.description", "i.link", "i.published", F.coalesce("i.categories", F.array().cast("array<string>")).alias("categories"))
    news = newsworthy(F.col("title"), F.col("link"), F.col("categories"))
    return out.withColumn("news", news).withColumn("admitted", F.coalesce("expect.excluded", F.lit(False)) | F.col("news"))


def run_cases(cases: DataFrame, background: DataFrame) -> DataFrame:
    """id, ok, failures (sorted) of each case. background: title, description of items that make frequencies real."""
    items = case_items(cases)
    checks = items.groupBy("id", "expect").agg(F.count_if("news").alias("news"), F.count(F.lit(1)).alias("n"))
    said = [
        checks.where("expect.excluded and news > 0").select("id", F.lit("excluded").alias("failure")),
        checks.where("expect.kept and news < n").select("id", F.lit("kept").alias("failure")),
    ]
    own = items.where("admitted").withColumn("place", F.row_number().over(rank.Window.partitionBy("id").orderBy("position")) - 1)
    # Each case is clustered with the whole background before it.
    back = cases.select("id").join(background.select("title", "description", F.monotonically_increasing_id().alias("b")))
    both = back.select("id", F.lit(0).alias("part"), F.col("b").alias("ix"), "title", "description", F.concat(F.lit("b"), F.col("b")).alias("key")).unionByName(own.select("id", F.lit(1).alias("part"), F.col("place").cast("long").alias("ix"), "title", "description", F.concat(F.lit("i"), F.col("place")).alias("key")))
    placed = cluster_items(both, "id", ["part", "ix"], "key").select("id", "key", "cluster_ix")
    pair = lambda kind: cases.select("id", F.explode(f"expect.pairs.{kind}").alias("p")).select("id", F.concat(F.lit("i"), F.get("p", F.lit(0))).alias("a"), F.concat(F.lit("i"), F.get("p", F.lit(1))).alias("b"))
    for kind, wrong in (("merge", "ca <> cb"), ("split", "ca = cb")):
        a, b = (placed.select("id", F.col("key").alias(k), F.col("cluster_ix").alias(f"c{k}")) for k in "ab")
        said.append(pair(kind).join(a, ["id", "a"]).join(b, ["id", "b"]).where(wrong).select("id", F.concat(F.lit(f"{kind} "), "a", F.lit(" "), "b").alias("failure")))
    landed = placed.where("key like 'i%'").groupBy("id").agg(F.count_distinct("cluster_ix").alias("c"))
    said.append(cases.select("id", "expect.clusters").join(landed, "id", "left").where("clusters <> coalesce(c, 0)").select("id", F.lit("clusters").alias("failure")))
    m = own.withColumn("member_ix", F.col("place")).withColumn("title_tokens", tokenize(F.col("title")))
    marked = rank.pick_headlines(m, ["id"])
    votes = topics.topic_votes(topics.topic_evidence(m), ["id"])
    heads = marked.where("is_headline").select("id", F.col("title").alias("headline"))
    found = topics.explained(votes.join(heads, "id")).select("id", "topic", "headline")
    wanted = cases.select("id", F.col("expect.topic").alias("want"), "expect.headlineNot", "expect.summaryNot", "expect.headlineIndex")
    judged = wanted.join(found, "id", "left")
    said.append(judged.where("want is not null and want <> coalesce(topic, 'world')").select("id", F.lit("topic").alias("failure")))
    said.append(judged.where("headline rlike concat('(?i)', headlineNot)").select("id", F.lit("headlineNot").alias("failure")))
    pinned = marked.join(wanted.select("id", "headlineIndex"), "id").withColumn("is_headline", F.when(F.col("headlineIndex").isNotNull(), F.col("place") == F.col("headlineIndex")).otherwise(F.col("is_headline")))
    text = rank.pick_summaries(pinned, ["id"]).where("summary_source is not null")
    said.append(wanted.join(text, "id").where("summary rlike concat('(?i)', summaryNot)").select("id", F.lit("summaryNot").alias("failure")))
    all_said = said[0]
    for s in said[1:]:
        all_said = all_said.unionByName(s)
    failures = all_said.groupBy("id").agg(F.sort_array(F.collect_list("failure")).alias("failures"))
    out = cases.select("id").join(failures, "id", "left")
    return out.select("id", F.col("failures").isNull().alias("ok"), F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))


def pass_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("passed"))


def triage(members: DataFrame) -> DataFrame:
    """Why members of clusters are in and how they rank: admitted, opinion, sensational, path, representative, place.

    The core here is that of all admitted members.
    """
    m = members.withColumn("title_tokens", tokenize(F.col("title"))).withColumn("path", url_path(F.coalesce("link", F.lit("")))).withColumn("admitted", newsworthy(F.col("title"), F.col("link"), F.col("categories"))).withColumn("opinion", opinion_score(F.col("title"))).withColumn("sensational", sensationalism(F.col("title")))
    out = m.join(rank.core_terms(m.where("admitted")), rank.KEYS, "left").withColumn("core", F.coalesce("core", F.array().cast("array<string>")))
    out = out.withColumn("representative", rank.representativeness(F.col("title_tokens"), F.col("core")))
    return out.withColumn("place", F.row_number().over(rank.Window.partitionBy(*rank.KEYS).orderBy(F.col("representative").desc(), "sensational", "member_ix")))
