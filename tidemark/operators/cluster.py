"""Clusters of items that report one event: a leader pass and one fold, in the order of the items.

The order decides the result, so an edition (a day's items) is one group; editions run side by side. Within a group an
index from terms to clusters limits comparisons to clusters that share a term.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.vectors import analysed

THRESHOLD, STRICT, FLOOR, PREDICATE_FLOOR, MIN_SHARED, MIN_PREDICATE = 0.20, 0.42, 0.03, 0.012, 2, 1


class Cluster:
    def __init__(self, number: int, vec: dict[str, float], names: set[str]):
        self.members, self.names, self.vec, self.square, self.vecs = [number], set(names), dict(vec), 1.0, [vec]
        self.scale = 1.0  # the true weight of a term is vec[term] * scale

    def weight(self, term: str) -> float:
        return self.vec[term] * self.scale

    def add(self, vec: dict[str, float]) -> list[str]:
        """Adds a vector and brings the length back to one; returns the terms that are new."""
        new = [t for t in vec if t not in self.vec]
        for t, w in vec.items():
            self.vec[t] = self.vec.get(t, 0.0) + w / self.scale
        norm = math.sqrt(sum(w * w for w in self.vec.values())) * self.scale
        if norm > 0:
            self.scale /= norm
        return new


def gated(a: dict[str, float], a_names: set[str], c: Cluster, floor: float, predicate_floor: float, min_predicate: int) -> bool:
    """Whether two vectors share two telling terms, and among their common words one that isn't a name."""
    shared, predicate = set(), 0
    for t, w in a.items():
        if t in c.vec:
            q = w * c.weight(t)
            if q >= floor:
                shared.add(t.removeprefix("@"))
            predicate += q >= predicate_floor and not t.startswith("@") and t not in a_names and t not in c.names
    return len(shared) >= MIN_SHARED and predicate >= min_predicate


def cluster_edition(terms: list[dict[str, float]], names: list[set[str]], threshold: float = THRESHOLD, strict: float = STRICT, floor: float = FLOOR, predicate_floor: float = PREDICATE_FLOOR, min_predicate: int = MIN_PREDICATE) -> list[list[int]]:
    """Clusters of the items (term frequencies and proper nouns, in order) as lists of their numbers."""
    df: dict[str, int] = {}
    for tf in terms:
        for t in tf:
            df[t] = df.get(t, 0) + 1
    vecs = []
    for tf in terms:
        raw = {t: f * w for t, f in tf.items() if (w := math.log((len(terms) + 1) / (df[t] + 0.5))) > 0}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vecs.append({t: w / norm for t, w in raw.items()} if norm else {})
    clusters: list[Cluster | None] = []
    having: dict[str, list[int]] = {}

    def scores(vec: dict[str, float], scale: float = 1.0) -> dict[int, float]:
        out: dict[int, float] = {}
        for t, w in vec.items():
            for k in having.get(t, ()):
                if c := clusters[k]:
                    out[k] = out.get(k, 0.0) + w * scale * c.weight(t)
        return out

    for n, vec in enumerate(vecs):
        best, high = None, 0.0
        for k, score in sorted(scores(vec).items()):
            if score > high and score >= (threshold if gated(vec, names[n], clusters[k], floor, predicate_floor, min_predicate) else strict):
                best, high = k, score
        if best is None:
            best, new = len(clusters), list(vec)
            clusters.append(Cluster(n, vec, names[n]))
        else:
            new = clusters[best].add(vec)
            clusters[best].members.append(n)
            clusters[best].vecs.append(vec)
            clusters[best].names |= names[n]
        for t in new:
            having.setdefault(t, []).append(best)
    for a, one in enumerate(clusters):
        if one is None:
            continue
        at = a
        # What a has taken in changes its scores, so they are made anew from there on.
        while True:
            merged = False
            for k, score in sorted(scores(one.vec, one.scale).items()):
                if k <= at:
                    continue
                other = clusters[k]
                here = {t: one.weight(t) for t in one.vec}
                if score >= (threshold if gated(here, one.names, other, floor, predicate_floor, min_predicate) else strict):
                    for v in other.vecs:
                        for t in one.add(v):
                            having.setdefault(t, []).append(a)
                    one.members += other.members
                    one.vecs += other.vecs
                    one.names |= other.names
                    clusters[k], at, merged = None, k, True
                    break
            if not merged:
                break
    return [c.members for c in clusters if c]


def cluster_items(items: DataFrame, edition: str = "edition", order: list[str] = ("feed_ix", "item_ix"), item: str = "item_id", **options) -> DataFrame:
    """edition, item, cluster_ix, member_ix."""
    rows = analysed(items).select(F.col(edition).alias("edition"), F.col(item).alias("item"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], "terms", "proper_nouns")
    by = [f"o{k}" for k in range(len(order))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*by, "item"], kind="stable", na_position="last")
        terms = []
        for heard in pdf["terms"]:
            tf: dict[str, float] = {}
            for e in heard:
                tf[e["term"]] = tf.get(e["term"], 0.0) + e["w"]
            terms.append(tf)
        out = cluster_edition(terms, [set(n) for n in pdf["proper_nouns"]], **options)
        ids, name = pdf["item"].tolist(), pdf["edition"].iloc[0]
        return pd.DataFrame([(name, ids[n], k, m) for k, members in enumerate(out) for m, n in enumerate(members)], columns=["edition", "item", "cluster_ix", "member_ix"])

    kind = dict(items.dtypes)
    return rows.groupBy("edition").applyInPandas(run, f"edition {kind[edition]}, item {kind[item]}, cluster_ix int, member_ix int").withColumnsRenamed({"edition": edition, "item": item})
