"""Builds an edition from landed or fetched feeds: python -m tidemark.cli --registry sources.json --raw FOLDER --out docs"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import filters, publish, rank, send
from tidemark.operators.cluster import cluster_items
from tidemark.sources import feeds, fetch
from tidemark.sources.saved import saved


def parse_args(args: list[str]) -> argparse.Namespace:
    """Unknown arguments end the program."""
    p = argparse.ArgumentParser(prog="tidemark", allow_abbrev=False)
    p.add_argument("--registry", required=True, help="JSON registry of sources")
    p.add_argument("--raw", help="folder of landed feed documents, one a source; without it feeds are fetched")
    p.add_argument("--fixture", help="JSON array of items instead of feeds")
    p.add_argument("--out", default="docs")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--max-age-hours", type=float, default=36)
    p.add_argument("--min-stories", type=int, default=5, help="fewer are not published")
    p.add_argument("--zone", default="UTC")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--quiet", action="store_true")
    return p.parse_args(args)


def build(items: DataFrame, now: datetime.datetime, limit: int = 10, hours: float = 36, fixture: bool = False) -> DataFrame:
    """items of one edition (with_registry) to its published stories. A fixture's items are taken as they are."""
    kept = items.withColumn("item_id", F.monotonically_increasing_id()).withColumn("edition", F.lit(now.strftime("%Y-%m-%d")))
    kept = saved(kept if fixture else filters.admitted(kept, F.lit(now), hours))
    members = saved(kept.join(cluster_items(kept, item="item_id"), ["edition", "item_id"]))
    return rank.build_stories(members, F.lit(now), limit)


def main(args: list[str], spark: SparkSession | None = None, now: datetime.datetime | None = None) -> int:
    a = parse_args(args)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = now or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    registry, _ = feeds.read_registry(spark, a.registry)
    tallied = None
    if a.fixture:
        items = feeds.read_fixture(spark, a.fixture, registry)
    else:
        if a.raw:
            raw = feeds.read_raw(spark, a.raw)
            answers = registry.select(F.col("id").alias("source_id"), "lean").join(raw, "source_id", "left").withColumn("error", F.when(F.col("xml").isNull(), "no document"))
        else:
            answers = fetch.fetch(registry)
        answers = saved(answers)
        tallied = fetch.tally(fetch.fetch_log(answers)).first().asDict(recursive=True)
        items = feeds.with_registry(feeds.parse_feeds(answers.where("xml is not null").select("source_id", "xml")), registry)
    stories = saved(build(items, now, a.limit, a.max_age_hours, bool(a.fixture)))
    if not a.fixture:
        try:
            publish.check_publishable(tallied["succeeded"], stories.count(), a.limit, least_stories=a.min_stories)
        except ValueError as e:  # the edition before stays
            print(e, file=sys.stderr)
            return 1
    if not a.quiet or a.dry_run:
        send.dry_run(stories, tallied)
    if not a.dry_run:
        publish.write_latest(stories, F.lit(now), a.zone, a.out, tallied)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
