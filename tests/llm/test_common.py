from pyspark.sql import functions as F

from tidemark.llm import _common


def test_components_of_a_star(spark):
    """A hub of 100,000 edges, and a path beside it."""
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    path = spark.range(200_000, 200_020).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = _common.components(star.union(path)).groupBy("component").count().collect()
    assert sorted(map(tuple, found)) == [(0, 100_001), (200_000, 21)]


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", 2)
    monkeypatch.setattr(_common, "HOT_KEYS", 1 << 40)
    edges = [(k, k + 7) for k in range(0, 60)] + [(5, 5), (3, 3), (100, 101), (101, 100)] + [(200, k) for k in range(201, 230)]
    found = dict(map(tuple, _common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {k: k % 7 for k in range(67)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 230)}


def test_spread_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    monkeypatch.setattr(_common, "HOT_KEYS", 1 << 40)
    rows = spark.createDataFrame([(k % 4, k) for k in range(10)] + [(1, 100 + k) for k in range(10)], "key long, x long")
    told = _common.stash(rows.groupBy("key").agg(F.count("*").alias("copies")).where("key < 3").withColumn("said", F.col("key") * 10), "told")
    got = {r["x"]: r["said"] for r in _common.spread(rows, told, ["key"], "copies").collect()}
    assert got == {r["x"]: (r["key"] * 10 if r["key"] < 3 else None) for r in rows.collect()}
