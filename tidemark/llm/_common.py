"""Helpers shared by the training-data operators: table access, lineage cuts, distributed ranks, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.saved import shared_dir

#: ASCII white space, the only separators of words here.
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot beyond so many rows and beyond one in HOT_KEYS of all; so there are at most HOT_KEYS hot ones.
HOT_ROWS, HOT_KEYS = 10_000, 1_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(target, "w") as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors.

    The files go with drop(), or when the application ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(schema).parquet(path)
    out._stash = target
    return out


def drop(*stashed: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing will read it any more."""
    for df in stashed:
        df._stash.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._stash, True)


def words(text):
    """Column: the words `[^\\x20\\x09-\\x0D]+` of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def partial_ranks(df: DataFrame, key: list[str], bucket: str, order: list) -> DataFrame:
    """Adds _local: the 0-based place among the rows of the same key and bucket.

    With the counts by key and bucket this makes a whole rank without one task for a whole key.
    """
    return df.withColumn("_local", F.row_number().over(Window.partitionBy(*key, bucket).orderBy(*order)) - 1)


def spread(rows: DataFrame, told: DataFrame, key: list[str], copies: str) -> DataFrame:
    """rows with the columns of told (stashed, one row for each key), left joined on key (not null).

    Keys that have more rows than one task should take, by the count in copies, are told by broadcast: at most
    HOT_KEYS of them. Their rows go to the shuffle under a hash of the whole row, so no task gets them all.
    """
    rest = [c for c in told.columns if c not in key and c != copies]
    bound = max(HOT_ROWS, (told.agg(F.sum(copies)).first()[0] or 0) // HOT_KEYS)
    hot = told.where(F.col(copies) > bound).select(*key, F.struct(*rest).alias("_hot"))
    cold = told.where(F.col(copies) <= bound).select(*[F.col(c).alias(f"_{c}") for c in key], F.struct(*rest).alias("_cold"))
    some = rows.join(F.broadcast(hot), key, "left").withColumn("_first", F.when(F.col("_hot").isNull(), F.col(key[0])).otherwise(F.xxhash64(*rows.columns).cast(dict(rows.dtypes)[key[0]])))
    on = (F.col("_first") == F.col(f"_{key[0]}")) & F.col("_hot").isNull()
    for c in key[1:]:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return some.join(cold, on, "left").select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in rest])


def lowest(edges: DataFrame, many: bool) -> DataFrame:
    """edges (u, v) with m, the least v of the same u. many: some u may have too many rows for one task."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    if not many:
        return edges.join(low.drop("degree"), "u")
    return spread(edges, stash(low, "lowest"), ["u"], "degree")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (u long, v long) as (node, component), component being the smallest node.

    Alternates large-star and small-star steps, each an aggregate by minimum and a join; a hub's edges are told the
    minimum by broadcast, so they are never gathered in one task. Every round is written to the shared folder. Loops
    and repeated edges are allowed; nodes without an edge do not appear.
    """
    edges = stash(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), name)
    state = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen, now = None, state()
    while now != seen:
        seen, many = now, now[0] > HOT_ROWS
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both, many).withColumn("m", F.least("m", "u")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if many:
            large = stash(large, name)
        small = lowest(large, many).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, stash(small, name)
        drop(before, *[large] * many)
        now = state()
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
