import hashlib
import random

import pytest

from tests.llm.helpers import empty_docs, odd_docs
from tidemark.llm import mixing


@pytest.mark.parametrize("seed", range(8))
def test_less_than_a_block_from_target(seed):
    r = random.Random(seed)
    weights = {f"s{k}": r.randint(1, 12) for k in range(r.randint(1, 9))}
    slots, q = mixing.period(weights), sum(weights.values())
    assert {s: slots.count(s) for s in weights} == weights
    for t in range(1, q + 1):
        for s, a in weights.items():
            assert abs(slots[:t].count(s) - t * a / q) < 1


def by_hand(rows, weights, block):
    """Slot by slot, with a new start whenever a source runs out."""
    queues = {s: [] for s in weights}
    for doc, source in sorted(rows, key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0])):
        queues[source if source in weights and source != "other" else "other"].append(doc)
    blocks = {s: [x[k : k + block] for k in range(0, len(x), block)] for s, x in queues.items()}
    out, slot = [], 0
    while any(blocks.values()):
        active = {s: a for s, a in weights.items() if blocks[s]}
        q, done = sum(active.values()), dict.fromkeys(active, 0)
        t = 0
        while all(blocks[s] for s in active):
            ready = [(-(-(done[s] + 1) * q // a), s) for s, a in active.items() if done[s] * q // a <= t]
            s = min(ready)[1]
            out += [(doc, s, slot) for doc in blocks[s].pop(0)]
            done[s] += 1
            t += 1
            slot += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_same_as_slot_by_slot(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", "zz", None])) for k in range(900)]
    weights = {"a": 2, "b": 5, "c": 3, "other": 1}
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), weights, 8).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(len(rows)))
    assert [(r["doc_id"], r["mix_stream"], r["mix_slot"]) for r in got] == by_hand(rows, {"other": 1} | weights, 8)


def test_order_of_files_and_odd_cases(spark):
    docs = odd_docs(spark)
    out = mixing.in_order(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(empty_docs(spark)).count() == 0 and mixing.in_order(empty_docs(spark)).count() == 0


def test_own_columns_named_like_the_mix(spark):
    docs = spark.createDataFrame([(k, f"src{k % 3}", 7, "x") for k in range(50)], "doc_id long, source string, mix_position long, Mix_slot string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns + [f"_mix_{c}" for c in ("stream", "block", "slot", "position")]
    assert sorted(r["_mix_position"] for r in out.collect()) == list(range(50)) and {r["mix_position"] for r in out.collect()} == {7}
    assert mixing.in_order(docs).columns == docs.columns and mixing.in_order(docs).count() == 50


def test_finer_buckets_give_the_same_mix(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"src{k % 3}") for k in range(400)], "doc_id long, source string")
    want = {r["doc_id"]: r["mix_position"] for r in mixing.mixed(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 0)
    assert {r["doc_id"]: r["mix_position"] for r in mixing.mixed(docs).collect()} == want
