"""Items as a stream: repeats within the age limit go, and each batch runs the daily build of the editions it touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.saved import shared_dir

from tidemark.functions.text import title_key
from tidemark.operators.filters import newsworthy
from tidemark.sources.feeds import ITEM


def read_items(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Landed item files (JSON lines) as a stream."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_trigger).json(path)


def admitted_stream(items: DataFrame, hours: int = 36) -> DataFrame:
    """Newsworthy dated items, the first of each feed's title key within the watermark."""
    good = items.where("published is not null").where(newsworthy(F.col("title"), F.col("link"), F.col("categories")))
    return good.withColumn("title_key", title_key(F.col("title"))).withWatermark("published", f"{hours} hours").dropDuplicatesWithinWatermark(["source_id", "title_key"])


def by_edition(items: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, zone: str = "America/Chicago"):
    """Starts a query that hands each batch, with its edition (the local day), to build(batch, number)."""
    dated = items.withColumn("edition", F.date_format(F.from_utc_timestamp("published", zone), "yyyy-MM-dd"))
    return dated.writeStream.option("checkpointLocation", checkpoint).foreachBatch(build).trigger(availableNow=True).start()


def volume(items: DataFrame, hours: int = 36) -> DataFrame:
    """Items and outlets by hour and lean, final once the watermark has passed."""
    return items.withWatermark("published", f"{hours} hours").groupBy(F.window("published", "1 hour"), "lean").agg(F.count(F.lit(1)).alias("items"), F.approx_count_distinct("outlet").alias("outlets"))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream, a bounded number of them in each batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern, since the stream reader takes a plain path for a folder; the table may be one file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parque[t]")


def event_volume(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


def daily_firsts(events: DataFrame) -> DataFrame:
    """The earliest event of each user, type and day; the state is one row for each of those."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events.groupBy("user_id", "event_type", day).agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", "day", F.col("m.event_id").alias("event_id"))


def drained(updates: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Runs a stream of updates until its input is used up; returns the last row of each key.

    Batches are written to the shared folder under their number, so a batch that runs again replaces its own files.
    """
    spark = updates.sparkSession
    top = shared_dir(spark) + f"/streams/{name}-{uuid.uuid4().hex}"
    columns = updates.columns

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{top}/out/number={number}")

    run = updates.writeStream.outputMode("update").option("checkpointLocation", f"{top}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    kinds = ", ".join(f"`{c}` {t}" for c, t in updates.dtypes) + ", _batch int, number int"
    rows = spark.read.schema(kinds).option("basePath", f"{top}/out").parquet(f"{top}/out")
    rest = [c for c in columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return last.select(*key, *[F.col("r").getField(c).alias(c) for c in rest])
