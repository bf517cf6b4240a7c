import numpy as np
import pytest

from tidemark.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, query, k):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    if query not in good:
        return []
    d = sorted((float(np.sqrt(((v - good[query]) ** 2).sum())), i) for i, v in good.items() if i != query)
    return d[:k]


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 8)) * 4
    return [(i, (centres[i % 12] + rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = {}
    for r in nb.search(df, df.where("vec_id % 10 = 0").select("vec_id"), **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_recall_and_exact_scores(spark):
    rows = vectors(1500)
    got = run(spark, rows, sample=600, parts=8, probes=3)
    hit = total = 0
    for q, found in got.items():
        want = brute(rows, q, 10)
        dist = dict((i, s) for s, i in brute(rows, q, len(rows)))
        assert found == sorted(found) and len(found) == 10
        assert all(abs(dist[i] - s) < 1e-12 for s, i in found)
        hit += len({i for _, i in want} & {i for _, i in found})
        total += 10
    assert len(got) == 150 and hit / total > 0.9


def test_all_probes_are_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(nb, "ROWS_BLOCK", 64)
    monkeypatch.setattr(nb, "QUERIES_BLOCK", 16)
    rows = vectors(300) + [(1000 + i, [1.0] * 8) for i in range(40)]
    got = run(spark, rows, parts=4, probes=4)
    assert {q: [(round(s, 9), i) for s, i in x] for q, x in got.items()} == {q: [(round(s, 9), i) for s, i in brute(rows, q, 10)] for q in got} and len(got) == 34


def test_odd_rows(spark):
    rows = vectors(12) + [(20, None), (30, []), (40, [0.0] * 8), (50, [1.0] * 7 + [float("nan")]), (60, [1.0] * 7 + [float("inf")]), (70, [1.0] * 7 + [None]), (None, [1.0] * 8), (80, [1.0] * 3), (10, vectors(12)[10][1])]
    got = run(spark, rows)
    assert set(got) == {0, 10} and all([i for _, i in got[q]] == [i for _, i in brute(rows, q, 10)] for q in got)
    few = run(spark, vectors(4))
    assert [i for _, i in few[0]] == [i for _, i in brute(vectors(4), 0, 10)] and len(few[0]) == 3
    assert run(spark, []) == {}


def test_partition_is_balanced():
    x = np.array([v for _, v in vectors(640)])
    label = nb.partition(nb.graph(x, 10), 8)
    assert np.bincount(label).tolist() == pytest.approx([80] * 8, abs=1)


def test_probes_follow_the_structure():
    """Clusters are searched in few parts, noise in nearly all; both reach the recall asked for."""
    rng = np.random.default_rng(2)
    noise = rng.standard_normal((1600, 32))
    centres = rng.standard_normal((40, 32)) * 6
    clusters = centres[rng.integers(0, 40, 1600)] + rng.standard_normal((1600, 32))
    few, many = nb.fewest_probes(clusters, 16, 0.96), nb.fewest_probes(noise, 16, 0.96)
    assert few <= 6 < 10 <= many <= 16


def test_measured_probes_reach_recall(spark):
    rows = vectors(1200, 5)
    got = run(spark, rows, sample=800, parts=12)
    hit = sum(len({i for _, i in brute(rows, q, 10)} & {i for _, i in found}) for q, found in got.items())
    assert len(got) == 120 and hit / 1200 > 0.9


def test_repeated_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = vectors(40) + [(10, [-9.0] * 8), (10, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for c in ("v", "part", "block", "chunk", "score", "rank", "query_id"):
        df = df.withColumn(c, F.lit("own"))
    got = {r["vec_id"]: r["score"] for r in nb.search(df, df.where("vec_id = 0").select("vec_id"), k=50).collect()}
    zero, ten = (np.array(v, np.float32).astype(float) for v in (rows[0][1], [-9.0] * 8))
    assert len(got) == 39 and abs(got[10] - np.sqrt(((zero - ten) ** 2).sum())) < 1e-12
