import numpy as np
import xxhash

from tests.llm.helpers import empty_docs, odd_docs, odd_rows, text
from tidemark.llm import simhash


def slow(t, size):
    words = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).decode()
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps, radius):
    """Component by smallest id of (id, fp), by comparing all."""
    label = {i: i for i, _ in fps}
    for _ in fps:
        was = dict(label)
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= radius:
                    label[i] = min(label[i], label[j])
        if was == label:
            return label
    return label


def test_fingerprint_matches_definition():
    for r in odd_rows():
        t = r[1] if r[1] is None or len(r[1]) < 5000 else r[1][:5000]
        assert simhash.fingerprint(t, 4) == slow(t, 4)
    assert simhash.fingerprint("one Two", 4) == slow("one Two", 4)


def test_the_engine_hashes_alike(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("quiet river stone and",)], "s string").select(F.xxhash64("s")).first()[0]
    assert row % 2**64 == xxhash.xxh64_intdigest(b"quiet river stone and", 42)


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = []
    for g in range(6):
        base = text(g, 60).split()
        for k in range(6):
            w = list(base)
            for _ in range(k):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(99)}"
            docs.append((len(docs) + 1, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "  ")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == groups([(i, simhash.fingerprint(t, 4)) for i, t in docs], 4)
    assert got[102] == 100


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False))) for b in base for _ in range(80)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    a, b = (simhash.ordered(x.astype("<u8").tobytes()) for x in (fps[::2], fps[1::2]))
    edges = [simhash.links(a, a, True, 4), simhash.links(b, b, True, 4), simhash.links(a, b, False, 4)]
    at = {int(x): k for k, x in enumerate(fps)}
    i = np.array([at[int(x)] for e in edges for x in e[0]])
    j = np.array([at[int(x)] for e in edges for x in e[1]])
    got = np.arange(len(fps))
    other, low = simhash.forest(i, j, len(fps))
    got[other] = low
    n = len(fps)
    near = np.bitwise_count(fps[:, None] ^ fps) <= 4
    want = np.arange(n)
    while True:
        new = np.array([want[near[k]].min() for k in range(n)])
        if (new == want).all():
            break
        want = new
    assert (got == want).all()
    assert all(int(x ^ y).bit_count() <= 64 for e in edges for x, y in zip(*e))


def test_one_document_of_each_group_stays(spark):
    docs = odd_docs(spark)
    out = simhash.simhash_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert ids.count(1) == 1 and ids.count(2) == 0
    assert len([i for i in ids if i in (4, 5, 6)]) == 1
    assert all(r["fp"] == "own fp" for r in rows)
    assert simhash.simhash_groups(docs).count() == docs.count()
    assert simhash.simhash_groups(empty_docs(spark)).count() == 0 and simhash.simhash_dedup(empty_docs(spark)).count() == 0


def test_dedup_reaches_similarity_of_eight_tenths(spark):
    rng = np.random.default_rng(8)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    docs, similar, alike = [], set(), 0
    for g in range(60):
        base = [f"w{rng.integers(9999)}" for _ in range(300)]
        near = list(base)
        for k in range(0, 300, int(rng.integers(20, 100))):
            near[k] = "new"
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
        x, y = (shingles(t) for _, t in docs[-2:])
        alike += len(x & y) / len(x | y) >= 0.8
        similar |= {2 * g + 1} if len(x & y) / len(x | y) >= 0.8 else set()
    assert 10 < alike < 50
    kept = {r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {2 * g for g in range(60)} <= kept and not {i for i, _ in docs if i % 2 and i not in similar} - kept
    assert len(similar & kept) <= 1


def test_candidates_reach_similarity_of_eight_tenths():
    """Measured recall at the threshold itself: at least 0.97 of 400 pairs of 300 shingles of Jaccard 0.8."""
    rng, met = np.random.default_rng(9), 0
    for _ in range(400):
        same, a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**9, n)) for n in (240, 30, 30))
        x, y = simhash.sketch(f"{same} {a}", 1), simhash.sketch(f"{same} {b}", 1)
        met += (x[2] ^ y[2]).bit_count() + (x[3] ^ y[3]).bit_count() <= 30
    assert met >= 388


def test_large_groups_of_near_copies_become_one(spark):
    base = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join([*base, f"end{k}"])) for k in range(3000)]
    assert [r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [0]


def test_minima_tell_similar_sets_from_others():
    """Sets of 100 shingles: of similarity 0.8 nearly all pass, of 0.6 hardly any."""
    rng, passed = np.random.default_rng(3), {}
    for common, own in ((80, 10), (60, 20)):
        far = []
        for _ in range(400):
            x = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
            a, b = (np.frombuffer(simhash.minima(h), "<u8") for h in (x[: common + own], np.concatenate([x[:common], x[common + own :]])))
            far.append(int(simhash.apart(a, b)))
        passed[common] = sum(f <= simhash.APART for f in far) / 400
    assert passed[80] >= 0.98 and passed[60] <= 0.1 and simhash.minima(np.array([], np.uint64)) == bytes(64)


def test_query_gives_hexadecimal_fingerprints(spark, tmp_path):
    rows = [(d, t if t is None or len(t) < 9000 else t[:9000]) for d, t, *_ in odd_rows() if d is not None] + [(-4, "Only Three Words"), (40, "only three\u00a0words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = simhash.op6_simhash(spark, str(tmp_path)).collect()
    want = {d: slow(t, 4) for d, t in rows}
    assert len(out) == len(rows) and {r["doc_id"]: r["fingerprint"] for r in out} == {d: f"{x:016x}" for d, x in want.items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == groups(list(want.items()), 4)


def close_numbers(seed, n):
    """Spread numbers, and some 1 to 6 bits from another."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False))) for b in base[:60] for _ in range(8)]
    return np.unique(np.concatenate([base, np.array([0, 1, 2**63, 2**64 - 1], np.uint64), np.array(near, np.uint64)]))


def test_masks_lose_no_link():
    """However many numbers: two within the radius agree under some mask."""
    rng = np.random.default_rng(2)
    for n, radius in ((100, 4), (3_000_000, 4), (10**9, 4), (10**15, 4), (5, 0), (10**6, 1), (100, 9)):
        masks = simhash.block_masks(n, radius)
        for _ in range(300):
            flipped = sum(1 << int(k) for k in rng.choice(64, radius, replace=False))
            assert any(not flipped & m for m in masks)
    assert len(simhash.block_masks(100, 4)) == 5 and len(simhash.block_masks(3_000_000, 4)) == 15


def test_runs_of_any_length_give_all_links():
    fps = close_numbers(8, 3000)
    for n in (1, 2, 63, 64, 65, 1024, 1500, len(fps)):
        mask = np.arange(len(fps)) // n
        near = (np.bitwise_count(fps[:, None] ^ fps) <= 4) & (mask[:, None] == mask)
        got = simhash.run_links(mask, np.zeros(len(fps), np.int64), fps, 4)
        at = [np.searchsorted(fps, x) for x in got]
        assert [x.tolist() for x in simhash.forest(*at, len(fps))] == [x.tolist() for x in simhash.forest(*np.nonzero(near), len(fps))]


def test_blocks_link_like_brute_force(spark, monkeypatch):
    """With batches that cut runs, with runs compared whole, and with hot blocks in tiles."""
    from pyspark.sql import functions as F

    fps = close_numbers(7, 2000)
    near = np.bitwise_count(fps[:, None] ^ fps) <= 4
    i, j = simhash.forest(*np.nonzero(near), len(fps))
    want = {int(x): int(y) for x, y in zip(fps[i].view(np.int64), fps[j].view(np.int64))}
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch, hot in (("10000", 10_000), ("7", 10_000), ("10000", 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        monkeypatch.setattr(simhash, "HOT_KEYS", 1_000 if hot > 3 else 1 << 40)
        edges = [(r["u"], r["v"]) for r in simhash.near_links(frame, 4).collect()]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
        at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
        i, j = simhash.forest(np.array([at[u] for u, _ in edges]), np.array([at[v] for _, v in edges]), len(fps))
        assert {int(x): int(y) for x, y in zip(fps[i].view(np.int64), fps[j].view(np.int64))} == want
    assert simhash.near_links(frame.where(F.lit(False)), 4).count() == 0


def test_comparisons_do_not_grow_with_the_square(monkeypatch):
    """Of 40,000 spread fingerprints under one in 500 pairs is compared."""
    fps, done, count = close_numbers(9, 40_000), [0], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (done.__setitem__(0, done[0] + x.size), count(x))[1])
    for k, mask in enumerate(simhash.block_masks(len(fps), 4)):
        x = fps[np.argsort(fps & np.uint64(mask), kind="stable")]
        simhash.run_links(np.full(len(x), k), x & np.uint64(mask), x, 4)
    assert 0 < done[0] < len(fps) ** 2 / 2 / 500
