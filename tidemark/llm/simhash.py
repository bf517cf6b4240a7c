"""SimHash near-duplicates: fingerprints of word shingles, exact comparison by blocks of bits, connected components.

Fingerprints are made once by Arrow batches (the hash and the bit counts are numpy's and xxhash's). Fingerprints within
the radius agree in all but radius of the blocks that the 64 bits are cut into, so distinct ones are sorted by the bits
under each mask that leaves so many blocks out, and only runs that agree there are compared: all links, without all
pairs. The number of blocks grows with the number of fingerprints. Runs too long for one task are laid into tiles by
population count; two tiles are compared only if their counts can differ by the radius at most, and inside a pair of
tiles blocks are skipped by the counts of quarters. A batch of runs or a pair of tiles returns a spanning forest of its
links, so thousands of near copies never become all their pairs and no link of components is lost.

`simhash_dedup`, the pipeline's stage, takes SimHashes of 128 bits for candidates only and links what has a Jaccard
similarity of 0.8 or more on exact shingles, of five words; the four words and the radius of four bits are op6's.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other; shorter texts than a shingle
hash their whole word sequence; repeated rows stay, each with its component; a null doc_id takes part but is never a
component's name unless all are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import HOT_KEYS, HOT_ROWS, components, drop, spread, stash, table

TILE = 32768
BLOCK = 1024
#: Rows of a block that are compared with another block at once.
STRIP = 64
#: Spread fingerprints that may be alike under a mask, and the run of these that is compared as a whole.
RUN, LONG = 512, 64


def fingerprint(text: str | None, size: int, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles of size words of text, A-Z lower-cased."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    n = max(1, len(found) - size + 1)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(size, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        total += np.unpackbits(hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, size) for t in pdf["text"]], np.uint64).view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For links i-j among n items: each item that isn't the smallest of its component, and that smallest."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, was[i], low)
        np.minimum.at(label, was[j], low)
        label = label[label]
        if np.array_equal(was, label):
            break
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    while not np.array_equal(label, label[label]):
        label = label[label]
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]


def ordered(blob: bytes) -> np.ndarray:
    """A tile's fingerprints by the counts of their halves and quarters, so that blocks of it are narrow."""
    x = np.frombuffer(blob, "<u8")
    quarter = [np.bitwise_count((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int16) for k in range(4)]
    return x[np.lexsort((quarter[2], quarter[0], quarter[0] + quarter[1]))]


def links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two ordered tiles as edges of a spanning forest of all their links within radius bits."""

    def ranges(x):
        parts = [np.bitwise_count((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int16) for k in range(4)]
        return [(k, np.array([[p[k : k + BLOCK].min(), p[k : k + BLOCK].max()] for p in parts])) for k in range(0, len(x), BLOCK)]

    us, vs, ra = [], [], ranges(a)
    rb = ra if same else ranges(b)
    for k, p in ra:
        left = a[k : k + BLOCK, None]
        for m, q in rb:
            if same and m < k or np.maximum(0, np.maximum(p[:, 0] - q[:, 1], q[:, 0] - p[:, 1])).sum() > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(left ^ b[None, m : m + BLOCK]) <= radius)
            if same and k == m:
                i, j = i[i < j], j[i < j]
            if len(i) > 4 * BLOCK:
                i, j = forest(i, j + BLOCK * (k != m or not same), 2 * BLOCK)
                both = np.concatenate([a[k : k + BLOCK], np.zeros(max(0, BLOCK - len(a[k : k + BLOCK])), np.uint64), b[m : m + BLOCK]])
                us.append(both[i]), vs.append(both[j])
            elif len(i):
                us.append(a[k + i]), vs.append(b[m + j])
    if not us:
        return np.array([], np.uint64), np.array([], np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = forest(at[: len(u)], at[len(u) :], len(names))
    return names[i], names[j]


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of 64 bits such that numbers within radius bits agree under one of them at least.

    The bits are cut into more blocks than radius, of which that many can differ at most; a mask leaves so many out.
    More blocks make more and longer masks, so they are as few as keep RUN of n spread numbers alike under a mask.
    """
    cut = next((c for c in range(radius + 1, radius + 4) if n >> (c - radius) * (64 // c) <= RUN), radius + 4)
    blocks = [sum(1 << k for k in range(64 * i // cut, 64 * (i + 1) // cut)) for i in range(cut)]
    return [sum(x) for x in combinations(blocks, cut - radius)]


def run_links(mask: np.ndarray, key: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links within radius bits inside runs of equal mask and key."""
    begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])]) if len(x) else np.array([], np.int64)
    count = np.diff(np.r_[begin, len(x)])
    us, vs = [], []
    for k, n in zip(begin[count >= LONG], count[count >= LONG]):
        run = x[k : k + n] if n <= BLOCK else ordered(x[k : k + n].astype("<u8").tobytes())
        u, v = links(run, run, True, radius)
        us.append(u), vs.append(v)
    left = np.repeat(np.where(count < LONG, begin + count, 0), count) - np.arange(len(x))
    i = np.flatnonzero(left > 1)
    for far in range(1, LONG):
        i = i[left[i] > far]
        near = i[np.bitwise_count(x[i] ^ x[i + far]) <= radius]
        us.append(x[near]), vs.append(x[near + far])
        if not len(i):
            break
    u, v = np.concatenate(us), np.concatenate(vs)
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = forest(at[: len(u)], at[len(u) :], len(names))
    return names[i], names[j]


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges u, v (longs) that connect all fp of distinct within radius bits of each other."""
    spark = distinct.sparkSession
    n = distinct.count()
    masks = np.array(block_masks(n, radius), np.uint64).view(np.int64).tolist()
    each = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(each).alias("e")).select("e.mask", "e.key", "fp")
    bound = max(HOT_ROWS, n * len(masks) // HOT_KEYS)
    hot = stash(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > bound).select("mask", "key"), "hot-blocks")
    some = hot.limit(1).count()
    cold = keyed.join(F.broadcast(hot), ["mask", "key"], "left_anti") if some else keyed

    def compare(batches):
        kept = pd.DataFrame({"mask": [], "key": [], "fp": []}, dtype=np.int64)
        for pdf in chain(batches, [None]):
            now = kept if pdf is None else pd.concat([kept, pdf])
            mask, key, x = (now[c].to_numpy() for c in ("mask", "key", "fp"))
            end = len(x)
            if pdf is not None and end:
                # The last run may go on in the next batch.
                others = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
                end = int(others[-1]) + 1 if len(others) else 0
            u, v = run_links(mask[:end], key[:end], x[:end].view(np.uint64), radius)
            kept = now.iloc[end:]
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cold.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key").mapInPandas(compare, "u long, v long")
    return found.union(tiled_links(keyed.join(F.broadcast(hot), ["mask", "key"]), radius)) if some else found


def tiled_links(hot: DataFrame, radius: int) -> DataFrame:
    """Edges u, v (longs) that connect all fp of the same mask and key within radius bits of each other, by tiles."""
    spark = hot.sparkSession
    counted = hot.select("mask", "key", "fp", F.bit_count("fp").alias("pc"))
    # At most 65 rows for each of HOT_KEYS.
    sizes = counted.groupBy("mask", "key", "pc").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.join(F.broadcast(sizes), ["mask", "key", "pc"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE)).cast("long"))

    def tile(key, pdf):
        return pd.DataFrame({"mask": [key[0]], "key": [key[1]], "pc": [key[2]], "part": [key[3]], "blob": [ordered(np.sort(pdf["fp"].to_numpy()).astype("<i8").tobytes()).tobytes()]})

    tiles = stash(dealt.groupBy("mask", "key", "pc", "part").applyInPandas(tile, "mask int, key long, pc int, part long, blob binary"), "tiles")
    left = tiles.select("mask", "key", F.col("pc").alias("pc_a"), F.col("part").alias("part_a"), F.col("blob").alias("a"), F.explode(F.array(*[F.col("pc") + k for k in range(radius + 1)])).alias("pc"))
    right = tiles.select("mask", "key", "pc", F.col("part").alias("part_b"), F.col("blob").alias("b"))
    pairs = left.join(right, ["mask", "key", "pc"]).where("pc > pc_a or part_b >= part_a").select("a", "b", ((F.col("pc") == F.col("pc_a")) & (F.col("part_a") == F.col("part_b"))).alias("same"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        for pdf in batches:
            for a, b, same in zip(pdf["a"], pdf["b"], pdf["same"]):
                u, v = links(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), bool(same), radius)
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.repartition(n).mapInPandas(compare, "u long, v long")


def simhash_groups(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links of at most radius bits reach."""
    marked = stash(fingerprints(docs, size), "fingerprints")
    distinct = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct")
    found = components(near_links(distinct, radius), "simhash")
    of = stash(distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("c")), "of")
    name = stash(of.groupBy("c").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")), "names")
    told = stash(spread(of.select("fp", "copies", "c"), name, ["c"], "members").select("fp", "copies", "component_id"), "told")
    drop(distinct, of, name)
    return spread(marked, told, ["fp"], "copies").select("doc_id", "fp", "component_id")


def sketch(text: str | None, size: int) -> tuple[np.ndarray, int, int, int]:
    """The distinct hashes of the shingles of text (sorted), a hash of this set, and its SimHash in two words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.array([], np.uint64), 0, 0, 0
    n = max(1, len(found) - size + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.fromiter((digest(b" ".join(found[k : k + size]), 42) for k in range(n)), np.uint64, n))
    # The second word counts the bits of the hashes mixed once more.
    more = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    words = []
    for x in (hashes, more ^ (more >> np.uint64(31))):
        total = np.zeros(64, np.int64)
        for k in range(0, len(x), 8192):
            total += np.unpackbits(x[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words.append(int(np.packbits(total * 2 > len(x), bitorder="little").view("<u8")[0]))
    return hashes, digest(hashes.astype("<u8").tobytes()), *words


#: How many smallest hashes a set is told apart by, two bits of each; at similarity 0.8 38 of them differ, sd 6.
MINIMA, APART = 256, 56
_ODD = np.random.default_rng(23).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(29).integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def minima(hashes: np.ndarray) -> bytes:
    """Two bits each of the smallest of the hashes under MINIMA mixings: of sets of similarity s a share of 0.75 * (1 - s) differs."""
    if not len(hashes):
        return bytes(MINIMA // 4)
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        low = np.minimum(low, ((hashes[k : k + 1024, None] ^ _SALT) * _ODD).min(0))
    # Mixed once more: the lowest bits of a product are those of its factors, the highest of a minimum are zero.
    mixed = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    two = (mixed >> np.uint64(62)).astype(np.uint8)
    return np.packbits(np.stack([two >> 1, two & 1], axis=1).ravel()).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of minima (uint64 words) how many pairs of bits differ."""
    z = a ^ b
    return np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)


def close(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j of pairs of rows of two blocks that bits, sizes and labels let be linked, and how many bits differ.

    Some rows at a time, so that blocks full of near copies take no more memory than others.
    """
    out = []
    for a in range(0, len(x), STRIP):
        i, j = np.nonzero(np.bitwise_count(x["f1"][a : a + STRIP, None] ^ y["f1"]) <= radius * 3 // 4)
        i += a
        good = x["label"][i] != y["label"][j]
        i, j = i[good], j[good]
        n, m = x["n"][i], y["n"][j]
        good = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
        i, j = i[good], j[good]
        bits = np.bitwise_count(x["f1"][i] ^ y["f1"][j]) + np.bitwise_count(x["f2"][i] ^ y["f2"][j])
        good = bits <= radius
        i, j, bits = i[good], j[good], bits[good]
        good = apart(x["m"][i], y["m"][j]) <= APART
        out.append((i[good].astype(np.int32), j[good].astype(np.int32), bits[good]))
    return tuple(map(np.concatenate, zip(*out)))


def candidates(a: np.ndarray, b: np.ndarray, same: bool, radius: int, thin: bool):
    """Yields (u, v, thinned): pairs of rows of two tiles (NODE, sorted by n) that 128 bits and sizes let be similar, of different labels.

    With thin, a pair of blocks with very many gives only the nearest partner of each row; the flag tells of it.
    """
    for k in range(0, len(a), BLOCK):
        x = a[k : k + BLOCK]
        for m in range(k if same else 0, len(b), BLOCK):
            y = b[m : m + BLOCK]
            if 5 * x["n"][-1] < 4 * y["n"][0] or 5 * y["n"][-1] < 4 * x["n"][0]:
                continue
            i, j, bits = close(x, y, radius)
            if same and k == m:
                i, j, bits = i[i < j], j[i < j], bits[i < j]
            thinned = thin and len(i) > 4 * BLOCK
            if thinned:
                order = np.argsort(bits, kind="stable")
                order = np.unique(np.concatenate([order[np.unique(side[order], return_index=True)[1]] for side in (i, j)]))
                i, j = i[order], j[order]
            if len(i):
                yield x["node"][i], y["node"][j], thinned


NODE = np.dtype([("node", "<i8"), ("n", "<i8"), ("f1", "<u8"), ("f2", "<u8"), ("label", "<i8"), ("m", "<u8", MINIMA // 32)])


def candidate_pairs(nodes: DataFrame, radius: int, thin: bool) -> DataFrame:
    """u, v, thinned: the candidates among nodes (node, n, f1, f2, m, label); a row without u tells of thinned blocks only.

    Sets of similarity 0.8 differ in size by a quarter at most, so their classes of size are the same or neighbours.
    """
    spark = nodes.sparkSession
    classed = nodes.where("n > 0").withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.26))).cast("int"))
    # One row for each class of size: below 60 for any text.
    sizes = {r["class"]: r["k"] for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("k")).collect()}
    if not sizes:
        return spark.createDataFrame([], "u long, v long, thinned boolean")
    tile_size = min(TILE, max(BLOCK, sum(sizes.values()) // 64))
    parts = F.element_at(F.create_map(*[F.lit(x) for c, k in sizes.items() for x in (c, -(-k // tile_size))]), F.col("class"))
    dealt = classed.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("long"))

    def tile(key, pdf):
        out = np.zeros(len(pdf), NODE)
        for c in ("node", "n", "label"):
            out[c] = pdf[c].to_numpy()
        for c in ("f1", "f2"):
            out[c] = pdf[c].to_numpy().view(np.uint64)
        out["m"] = np.frombuffer(b"".join(map(bytes, pdf["m"])), "<u8").reshape(len(pdf), -1)
        return pd.DataFrame({"class": [key[0]], "part": [key[1]], "blob": [out[np.argsort(out["n"], kind="stable")].tobytes()]})

    tiles = stash(dealt.groupBy("class", "part").applyInPandas(tile, "class int, part long, blob binary"), "tiles")
    left = tiles.select(F.col("class").alias("class_a"), F.col("part").alias("part_a"), F.col("blob").alias("a"), F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    right = tiles.select("class", F.col("part").alias("part_b"), F.col("blob").alias("b"))
    pairs = left.join(right, "class").where("class > class_a or part_b >= part_a").select("a", "b", F.expr("class = class_a and part_a = part_b").alias("same"))

    def compare(batches):
        for pdf in batches:
            for a, b, same in zip(pdf["a"], pdf["b"], pdf["same"]):
                for u, v, thinned in candidates(np.frombuffer(a, NODE), np.frombuffer(b, NODE), bool(same), radius, thin):
                    yield pd.DataFrame({"u": u, "v": v, "thinned": np.full(len(u), thinned)})

    return pairs.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(compare, "u long, v long, thinned boolean")


def similar_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs u, v whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    ids = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = nodes.join(ids, "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.hash").alias("_hash"))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("node", "text").dropDuplicates(["node"])

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "shingles": [sketch(t, size)[0].view(np.int64) for t in pdf["text"]]})

    sets = stash(texts.mapInPandas(run, "node long, shingles array<long>"), "shingles")
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    both = F.size(F.array_intersect("a", "b"))
    found = stash(pairs.join(a, "u").join(b, "v").where(9 * both >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "similar")
    drop(sets)
    return found


def similar_components(docs: DataFrame, nodes: DataFrame, size: int, radius: int) -> DataFrame:
    """node, c: components of nodes by links that are verified.

    Large groups of near copies give the nearest links first; what these leave in different components is compared
    again, at last without leaving out any pair.
    """
    known, labels = None, nodes.select("node", F.col("node").alias("c"))
    for thin in (True, True, False):
        labelled = nodes.join(labels, "node").select("node", "n", "f1", "f2", "m", F.col("c").alias("label"))
        pairs = stash(candidate_pairs(labelled, radius, thin), "candidates")
        links = similar_links(docs, nodes, pairs, size)
        known = links if known is None else known.union(links)
        found = components(known, "similar")
        labels = stash(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("c")), "labels")
        if not pairs.where("thinned").limit(1).count():
            break
    return labels


def simhash_dedup(docs: DataFrame, size: int = 5, radius: int = 30) -> DataFrame:
    """One row of docs for each component, the one of its smallest doc_id, with all columns.

    Documents are linked if the Jaccard similarity of their sets of shingles is 0.8 or more. Candidates are pairs
    whose SimHashes of 128 bits differ in at most radius bits; at 0.8 about 19 differ, so 30 miss under one in a
    hundred. Short texts have coarse SimHashes, so candidates' smallest hashes are compared too (APART). Where several rows have that doc_id and text, one of them stays.
    """

    # Rows are found again by doc_id and a hash of the text, so no copy of the texts is made.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.xxhash64("text").alias("hash"))

    @F.pandas_udf("node long, n long, f1 long, f2 long, m binary")
    def marks(text: pd.Series) -> pd.DataFrame:
        rows, ms = [], []
        for x, h, f, g in (sketch(t, size) for t in text):
            rows.append((h, len(x), f, g))
            ms.append(minima(x))
        out = pd.DataFrame(np.array(rows, np.uint64).reshape(-1, 4).view(np.int64), columns=["node", "n", "f1", "f2"])
        out["m"] = ms
        return out

    marked = stash(docs.select("doc_id", F.xxhash64("text").alias("hash"), marks("text").alias("m")).select("doc_id", "hash", "m.*"), "marked")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    nodes = stash(marked.groupBy("node").agg(F.min(named).alias("first"), *[F.first(c).alias(c) for c in ("n", "f1", "f2", "m")]), "nodes")
    drop(marked)
    of = nodes.select("node", "first").join(similar_components(docs, nodes, size, radius), "node")
    best = stash(of.groupBy("c").agg(F.min("first").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.hash").alias("_hash")), "kept")
    kept = own.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).dropDuplicates(["doc_id", "hash"])
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op6_simhash(spark, sf_dir):
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
