"""The leader pass and the fold, on small invented items, against a plain loop over all clusters."""

import math
import random

from tidemark.operators.cluster import FLOOR, MIN_PREDICATE, MIN_SHARED, PREDICATE_FLOOR, STRICT, THRESHOLD, cluster_edition, cluster_items


def brute(terms, names):
    n = len(terms)
    df = {t: sum(t in x for x in terms) for x in terms for t in x}
    vecs = []
    for x in terms:
        raw = {t: f * math.log((n + 1) / (df[t] + 0.5)) for t, f in x.items()}
        size = math.sqrt(sum(w * w for w in raw.values())) or 1
        vecs.append({t: w / size for t, w in raw.items()})

    def merge(c, v):
        for t, w in v.items():
            c["v"][t] = c["v"].get(t, 0) + w
        size = math.sqrt(sum(w * w for w in c["v"].values()))
        c["v"] = {t: w / size for t, w in c["v"].items()}

    def fits(v, own, c):
        q = {t: w * c["v"][t] for t, w in v.items() if t in c["v"]}
        shared = len({t.removeprefix("@") for t, x in q.items() if x >= FLOOR})
        plain = sum(x >= PREDICATE_FLOOR and not t.startswith("@") and t not in own | c["n"] for t, x in q.items())
        score = sum(q.values())
        return score, score >= (THRESHOLD if shared >= MIN_SHARED and plain >= MIN_PREDICATE else STRICT)

    out = []
    for k in range(n):
        best, high = None, 0
        for c in out:
            score, good = fits(vecs[k], names[k], c)
            if good and score > high:
                best, high = c, score
        if best is None:
            out.append({"v": dict(vecs[k]), "n": set(names[k]), "m": [k]})
        else:
            merge(best, vecs[k])
            best["n"] |= names[k]
            best["m"].append(k)
    a = 0
    while a < len(out):
        b = a + 1
        while b < len(out):
            if fits(out[a]["v"], out[a]["n"], out[b])[1]:
                gone = out.pop(b)
                for k in gone["m"]:
                    merge(out[a], vecs[k])
                out[a]["m"] += gone["m"]
                out[a]["n"] |= gone["n"]
            else:
                b += 1
        a += 1
    return [c["m"] for c in out]


def test_same_as_plain_loops():
    for seed in range(6):
        r = random.Random(seed)
        events = [[f"w{r.randrange(60)}" for _ in range(6)] for _ in range(8)]
        terms, names = [], []
        for _ in range(40):
            e = r.choice(events)
            own = {r.choice(e): 1.0 + 0.45 * r.randrange(3) for _ in range(5)} | {f"x{r.randrange(99)}": 1.0, f"@n{r.randrange(20)}": 1.7}
            terms.append(own)
            names.append({t[1:] for t in own if t.startswith("@")})
        assert cluster_edition(terms, names) == brute(terms, names)


def test_events_of_headlines(spark):
    said = [
        ("Ferry sinks off Chile coast, ten passengers dead", "a"), ("Ten dead as ferry sinks off the coast of Chile", "a"), ("Chile ferry sinking: ten passengers drown off coast", "a"),
        ("Central bank in Norway raises interest rates sharply", "b"), ("Norway raises interest rates in surprise central bank move", "b"),
        ("Wildfire closes schools in northern Portugal", "c"), ("New museum of glass opens its doors in Murano", "d"),
    ]
    items = spark.createDataFrame([(k, "e", 0, k, t, "") for k, (t, _) in enumerate(said)], "item_id long, edition string, feed_ix int, item_ix long, title string, description string")
    got = {r["item_id"]: r["cluster_ix"] for r in cluster_items(items, item="item_id").collect()}
    for a, (_, x) in enumerate(said):
        for b, (_, y) in enumerate(said):
            assert (got[a] == got[b]) == (x == y), (said[a], said[b])
    assert cluster_items(items.limit(0), item="item_id").collect() == []
