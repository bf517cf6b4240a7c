"""Approximate nearest neighbours by learned partitions.

Fit, on the driver and on a bounded sample (the first rows by md5 of vec_id, SAMPLE at least and SAMPLE_MOST at most):
an exact neighbour graph, its balanced partition into parts by recursive bisection (spectral start, then swaps that
lower the cut), and a small network that predicts a vector's part. There is a part for every PART_ROWS rows, within
what the sample can teach. How many parts a query visits is measured, not guessed: on a quarter of the sample that a
first router was not taught, the fewest that hold TARGET of the true neighbours. So data with structure are searched
in a few parts and data without any in nearly all; probes sets a number instead.

Index: every row goes to its most probable part. Search: each query visits its most probable parts, in full, and
distances are exact in double precision. Parts are dealt in blocks of bounded rows, and queries in blocks too, so that
neither a crowded part nor many queries meet in one task.

Cases: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite numbers
take no part, nor do rows without vec_id; of rows of one vec_id the one with the smallest vector counts, compared
number by number; equal distances rank by vec_id; with fewer rows than asked for a query gets all of them; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import stash, table

SAMPLE, SAMPLE_MOST, PARTS, PART_ROWS, TARGET, NEIGHBOURS = 4096, 32768, 16, 8192, 0.93, 10
ROWS_BLOCK, QUERIES_BLOCK = 16384, 4096


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k nearest others, exactly."""
    out, sq = [], (x * x).sum(1)
    for a in range(0, len(x), 512):
        d = sq[a : a + 512, None] + sq - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 2), axis=1)[:, :k])
    return np.concatenate(out)


def bisect(near: np.ndarray, rows: np.ndarray, share: float, passes: int = 8) -> np.ndarray:
    """Whether each of rows (indices of the graph) falls in the first side, which takes share of them."""
    n, where = len(rows), np.full(len(near), -1)
    where[rows] = np.arange(n)
    i = np.repeat(np.arange(n), near.shape[1])
    j = where[near[rows]].ravel()
    i, j = i[j >= 0], j[j >= 0]
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    degree = np.bincount(i, minlength=n) + 1e-9
    v = np.random.default_rng(7).standard_normal(n)
    for _ in range(80):  # second eigenvector of the lazy random walk
        v = 0.5 * v + 0.5 * np.bincount(i, v[j], n) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.abs(v).max() + 1e-300
    side, left = np.zeros(n, bool), max(1, min(n - 1, round(n * share)))
    side[np.argsort(v, kind="stable")[:left]] = True
    for _ in range(passes):  # swap those that gain most, as long as pairs gain
        across = side[i] != side[j]
        gain = np.bincount(i, np.where(across, 1.0, -1.0), n)
        a, b = (s[np.argsort(-gain[s], kind="stable")] for s in (np.flatnonzero(side), np.flatnonzero(~side)))
        m = min(len(a), len(b))
        good = int((gain[a[:m]] + gain[b[:m]] > 2).sum()) // 2
        if not good:
            break
        side[a[:good]], side[b[:good]] = False, True
    return side


def partition(near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row of the graph; sizes differ by rounding only."""
    label, todo = np.zeros(len(near), np.int64), [(np.arange(len(near)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        side = bisect(near, rows, (n // 2) / n)
        todo += [(rows[side], first, n // 2), (rows[~side], first + n // 2, n - n // 2)]
    return label


class Router:
    """A network of one hidden layer from standardised vectors to the parts of their neighbours.

    goal: by row of x, the share of its neighbourhood in each part.
    """

    def __init__(self, x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 60):
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z, n, parts = (x - self.mean) / self.scale, len(x), goal.shape[1]
        w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
        m, s, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, 256):
                at = order[a : a + 256]
                h = np.maximum(0, z[at] @ w[0] + w[1])
                p = (self.soft(h @ w[2] + w[3]) - goal[at]) / len(at)
                back = (p @ w[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((z[at].T @ back + 1e-4 * w[0], back.sum(0), h.T @ p + 1e-4 * w[2], p.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    w[k] = w[k] - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    @staticmethod
    def soft(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.soft(np.maximum(0, (x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])


def taught_router(x: np.ndarray, parts: int, near_by: int = 10) -> Router:
    if parts < 2:
        return Router(x, np.ones((len(x), 1)), epochs=0)
    near = graph(x, min(near_by, len(x) - 1))
    label = partition(near, parts)
    goal = np.zeros((len(x), parts))
    for column in (*near.T, np.arange(len(x))):
        goal[np.arange(len(x)), label[column]] += 1
    return Router(x, goal / goal.sum(1, keepdims=True))


def fewest_probes(x: np.ndarray, parts: int, target: float, k: int = NEIGHBOURS) -> int:
    """How many parts to visit to find target of the k nearest rows, measured on rows that the router was not taught.

    Rows of x are in random order: the last quarter asks, the rest teaches and is searched.
    """
    if parts < 2:
        return parts
    taught, asked = x[: len(x) * 3 // 4], x[len(x) * 3 // 4 :][:1024]
    router = taught_router(taught, parts)
    of, k = router.scores(taught).argmax(1), min(k, len(taught))
    order = np.argsort(-router.scores(asked), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")  # by part, when it is visited
    needs = []
    for a in range(0, len(asked), 256):
        q = asked[a : a + 256]
        d = (taught * taught).sum(1) - 2 * q @ taught.T
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        needs.append(np.take_along_axis(place[a : a + 256], of[near], axis=1).ravel())
    found = np.cumsum(np.bincount(np.concatenate(needs), minlength=parts)) / (len(asked) * k)
    return int(np.searchsorted(found, target)) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By query: its id repeated, ids and distances of its k nearest rows other than its own, ties to the smaller id."""
    out, sq = [], (x * x).sum(1)
    for a in range(0, len(q), 64):
        d2 = (q[a : a + 64] ** 2).sum(1)[:, None] + sq - 2 * q[a : a + 64] @ x.T
        for r in range(len(d2)):
            row, other = d2[r], ids != q_ids[a + r]
            row[~other] = np.inf
            # All that rounding could bring among the k nearest are compared exactly.
            slack = 1e-9 * (sq.max() + (q[a + r] ** 2).sum())
            bound = np.partition(row, k - 1)[k - 1] + slack if len(row) > k else np.inf
            at = np.flatnonzero((row <= bound) & other)
            d = np.sqrt(((x[at] - q[a + r]) ** 2).sum(1))
            best = np.lexsort((ids[at], d))[:k]
            out.append((np.full(len(best), q_ids[a + r]), ids[at][best], d[best]))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, sample: int = SAMPLE, parts: int = PARTS, probes: int | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors that queries (vec_id) names, against all rows."""
    spark = vectors.sparkSession
    rows = stash(usable(vectors), "vectors")
    n = rows.count()
    sample, parts = max(sample, min(SAMPLE_MOST, n // 50)), max(parts, n // PART_ROWS)
    taught = [np.array(r["v"]) for r in rows.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(sample).collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not taught:
        return spark.createDataFrame([], schema)
    dim = Counter(map(len, taught)).most_common(1)[0][0]
    taught = np.stack([t for t in taught if len(t) == dim])
    parts = max(1, min(parts, len(taught) // 32))
    probes = min(parts, fewest_probes(taught, parts, target, k) if probes is None else probes)
    router = spark.sparkContext.broadcast(taught_router(taught, parts))

    def index(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "part": router.value.scores(x).argmax(1).astype(np.int32)})

    indexed = stash(rows.where(F.size("v") == dim).mapInPandas(index, "vec_id long, v array<double>, part int"), "index")
    counts = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {p: -(-n // ROWS_BLOCK) for p, n in counts.items()}
    asked = stash(indexed.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "v"), "queries")
    chunks = max(1, -(-asked.count() // QUERIES_BLOCK))
    per = F.element_at(F.create_map(*[F.lit(x) for p, n in blocks.items() for x in (p, n)]), F.col("part"))
    left = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), per).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def route(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            order = np.argsort(-router.value.scores(np.stack(pdf["v"].to_numpy())), axis=1, kind="stable")
            out = []
            for vec_id, v, by in zip(pdf["vec_id"], pdf["v"], order.tolist()):
                seen = 0
                for n, p in enumerate(by):
                    if n >= probes and seen > k:
                        break
                    seen += counts.get(p, 0)
                    out += [(vec_id, v, p, b) for b in range(blocks.get(p, 0))]
            yield pd.DataFrame(out, columns=["vec_id", "v", "part", "block"])

    right = asked.mapInPandas(route, "vec_id long, v array<double>, part int, block int").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int"))

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        got = nearest(q["vec_id"].to_numpy(), np.stack(q["v"].to_numpy()), x["vec_id"].to_numpy(), np.stack(x["v"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*got)))))

    keys = ["part", "block", "chunk"]
    met = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op2_learned_partitions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"))
