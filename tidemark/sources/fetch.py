"""Feeds over HTTP: a registry's rows to a log with each answer, fetched by the executors, a bounded number at a time."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.feeds import parse_feeds

TIMEOUT_SECONDS, TRIES, AT_ONCE, ERROR_LETTERS = 20.0, 2, 12, 120


def get(url: str | None, timeout: float = TIMEOUT_SECONDS, tries: int = TRIES) -> tuple[str | None, str | None]:
    """(body, None), or (None, what went wrong): redirects are followed, any answer but 2xx is an error, and it is tried again."""
    said = "no url"
    for _ in range(tries if url else 0):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "tidemark"}), timeout=timeout) as answer:
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            said = f"HTTP {e.code}"
        except Exception as e:  # a feed may fail in any way, and the others go on
            said = str(getattr(e, "reason", e)) or type(e).__name__
    return None, said[:ERROR_LETTERS]


def fetch(registry: DataFrame, timeout: float = TIMEOUT_SECONDS, tries: int = TRIES, at_once: int = AT_ONCE, tasks: int = 1) -> DataFrame:
    """registry (id, lean, url) to source_id, lean, xml, error; at_once requests in each of tasks tasks, an answer for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                answers = list(pool.map(lambda u: get(u, timeout, tries), pdf["url"]))
                yield pd.DataFrame({"source_id": pdf["id"], "lean": pdf["lean"], "xml": [a[0] for a in answers], "error": [a[1] for a in answers]})

    return registry.select("id", "lean", "url").repartition(tasks).mapInPandas(run, "source_id string, lean string, xml string, error string")


def fetch_log(fetched: DataFrame) -> DataFrame:
    """fetched (saved by the caller: it is read twice) with its items counted: source_id, lean, ok, items, error."""
    counts = parse_feeds(fetched.where("xml is not null").select("source_id", "xml")).groupBy("source_id").agg(F.count(F.lit(1)).alias("items"))
    return fetched.join(counts, "source_id", "left").select("source_id", "lean", F.col("error").isNull().alias("ok"), F.coalesce("items", F.lit(0)).cast("long").alias("items"), "error")


def works() -> Column:
    """Whether a feed of a log answered, and with items."""
    return F.col("ok") & (F.col("items") > 0)


def tally(log: DataFrame) -> DataFrame:
    """One row: attempted, succeeded and failed (id and error by id, as many as failed) of a log."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct(F.col("source_id").alias("id"), F.coalesce("error", F.lit("")).alias("error")))))
    return log.agg(F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("succeeded"), failed.alias("failed"))


def probe_list(log: DataFrame) -> DataFrame:
    """The log with the feeds that work first, those of most items before others."""
    return log.withColumn("works", works()).orderBy(F.col("works").desc(), F.col("items").desc(), "source_id")


def probe_passes(log: DataFrame, least: int = 5) -> bool:
    """Whether enough feeds work for an edition."""
    return log.where(works()).limit(least).count() >= least
