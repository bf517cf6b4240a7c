"""Term vectors of items within an edition, and the evidence that two items report one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import entities, stem, strip_html, tokenize

ENTITY_BOOST, DESCRIPTION_WEIGHT, DESCRIPTION_TOKENS, DESCRIPTION_ENTITIES = 1.7, 0.45, 40, 20


def analysed(items: DataFrame) -> DataFrame:
    """items with title_tokens, and terms: what each item says and how loudly, repeats included."""
    plain = items.withColumn("_t", strip_html(F.col("title"))).withColumn("_d", strip_html(F.col("description")))
    parts = plain.withColumn("title_tokens", tokenize(F.col("_t"), True)).withColumn("_te", entities(F.col("_t"), True)).withColumn("_dt", F.slice(tokenize(F.col("_d"), True), 1, DESCRIPTION_TOKENS)).withColumn("_de", F.slice(entities(F.col("_d"), True), 1, DESCRIPTION_ENTITIES))
    weigh = lambda c, w, mark: F.transform(c, lambda t: F.struct(F.concat(F.lit(mark), t).alias("term"), F.lit(w).alias("w")))
    terms = F.concat(weigh("title_tokens", 1.0, ""), weigh("_te", ENTITY_BOOST, "@"), weigh("_dt", DESCRIPTION_WEIGHT, ""), weigh("_de", DESCRIPTION_WEIGHT * ENTITY_BOOST, "@"))
    names = F.array_distinct(F.flatten(F.transform(F.concat("_te", "_de"), lambda e: F.transform(F.split(e, " +"), stem))))
    return parts.withColumn("terms", terms).withColumn("proper_nouns", names).drop("_t", "_d", "_te", "_dt", "_de")


def term_weights(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys (edition first, then what names an item), term, tf, proper (the term is a name, or part of one)."""
    each = analysed(items).select(*keys, "proper_nouns", F.explode("terms").alias("e"))
    # The names of an item are the same in all its rows, so they come along in the map-side sums.
    proper = F.col("e.term").startswith("@") | F.array_contains("proper_nouns", F.col("e.term"))
    return each.select(*keys, F.col("e.term").alias("term"), F.col("e.w").alias("w"), proper.alias("proper")).groupBy(*keys, "term").agg(F.sum("w").alias("tf"), F.bool_or("proper").alias("proper"))


def idf(weights: DataFrame, edition: str, keys: list[str]) -> DataFrame:
    """edition, term, df, idf: ln((items + 1) / (df + 0.5)) over the items of the edition that have a term."""
    counts = weights.groupBy(edition, "term").agg(F.count(F.lit(1)).alias("df"))
    items = weights.select(*keys).distinct().groupBy(edition).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(items, edition).select(edition, "term", "df", F.log((F.col("n") + 1) / (F.col("df") + F.lit(0.5))).alias("idf"))


def unit_vectors(weights: DataFrame, keys: list[str]) -> DataFrame:
    """weights with w: tf * idf, scaled so that an item's squares sum to one."""
    raw = weights.join(idf(weights, keys[0], keys), [keys[0], "term"]).withColumn("raw", F.col("tf") * F.col("idf")).where("raw > 0")
    norms = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, keys).select(*keys, "term", "proper", (F.col("raw") / F.col("norm")).alias("w"))


def pair_evidence(vectors: DataFrame, edition: str, item: str, floor: float = 0.03, predicate_floor: float = 0.012) -> DataFrame:
    """For items of an edition that share a term: edition, a, b, cosine, shared, predicate, exclusive_a, exclusive_b,
    contested, ratio (null where the cosine is zero).

    Pairs that share nothing have no evidence and no row, so the work follows the terms' own frequencies.
    """
    side = lambda x: vectors.select(F.col(edition).alias("e"), "term", F.col(item).alias(x), F.col("w").alias(f"w{x}"), F.col("proper").alias(f"p{x}"))
    met = side("a").join(side("b"), ["e", "term"]).where("a < b").withColumn("q", F.col("wa") * F.col("wb"))
    bare = F.regexp_replace("term", "^@", "")
    sums = met.groupBy("e", "a", "b").agg(
        F.sum("q").alias("cosine"),
        F.count_distinct(F.when(F.col("q") >= floor, bare)).alias("shared"),
        F.count_if((F.col("q") >= predicate_floor) & ~F.col("pa") & ~F.col("pb")).alias("predicate"),
    )
    # The heaviest name of one item that the other lacks: its names by weight, less those shared.
    names = vectors.where("proper").groupBy(F.col(edition).alias("e"), F.col(item).alias("i")).agg(F.sort_array(F.collect_list(F.struct("w", "term")), asc=False).alias("names"))
    common = met.groupBy("e", "a", "b").agg(F.collect_set("term").alias("common"))

    def peak(c: Column, common: Column) -> Column:
        return F.coalesce(F.get(F.filter(c, lambda x: ~F.array_contains(common, x["term"])), F.lit(0))["w"], F.lit(0.0))

    both = sums.join(common, ["e", "a", "b"]).join(names.select("e", F.col("i").alias("a"), F.col("names").alias("na")), ["e", "a"], "left").join(names.select("e", F.col("i").alias("b"), F.col("names").alias("nb")), ["e", "b"], "left")
    out = both.withColumn("exclusive_a", peak(F.col("na"), F.col("common"))).withColumn("exclusive_b", peak(F.col("nb"), F.col("common"))).withColumn("contested", F.least("exclusive_a", "exclusive_b"))
    return out.select(F.col("e").alias(edition), "a", "b", "cosine", "shared", "predicate", "exclusive_a", "exclusive_b", "contested", F.when(F.col("cosine") > 0, F.col("contested") / F.col("cosine")).alias("ratio"))
