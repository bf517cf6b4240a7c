"""Best-fit packing of tokenised documents by a plan over the histogram of lengths.

Documents are tokenised once into pieces (no ids are kept for the plan). The plan runs best-fit decreasing over the
count of each length: whole groups of equally filled sequences move at once, so it takes as many steps for a billion
documents as for a million, and the plan has at most capacity ** 2 rows. Each piece then takes a slot by its rank
within its length. Ranks come from ranks within (length, bucket) and the bucket counts, so no length is gathered in
one task.

Cases: a null text is an empty one and packs as the end token alone; repeated rows are packed each; equal pieces may
exchange their slots; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import partial_ranks, stash, table

CAPACITY = 1024
END = 2
BUCKETS = 256
VOCABULARY = "byte_bpe_50k.json"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to lists of ids. For a byte-level BPE with a rank file beside it, tiktoken's encoder is
    used, which gives the ids of the tokenizers file several times as fast (tests hold them equal)."""
    from pathlib import Path

    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import json

    import public_tokenizers
    import tiktoken

    special = {x["content"]: x["id"] for x in json.loads(Path(path).read_text())["added_tokens"]}
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)
    return lambda texts: [own.encode(t, allowed_special="all") if "<|" in t else own.encode_ordinary(t) for t in texts]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces_of(ids: list[int], capacity: int) -> list[tuple[int, int]]:
    """start and length of each piece: all of capacity, but for the first, which takes the rest."""
    if len(ids) <= capacity:
        return [(0, len(ids))]
    rest = len(ids) % capacity
    cuts = [0] * bool(rest) + list(range(rest, len(ids) + 1, capacity))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """A row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32 and, if asked for, ids and _order."""
    own, placed = [] if order is None else [F.col(order).cast("long").alias("_order")], order is not None

    def run(batches):
        encode = encoder(path)
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                out = []
                places = part["_order"] if placed else [0] * len(part)
                for doc, place, ids in zip(part["doc_id"], places, encode([t or "" for t in part["text"]])):
                    ids.append(end)
                    packed = np.array(ids, "<u4")
                    out += [(doc, n, a, m, zlib.crc32(packed[a : a + m].tobytes()), *([ids[a : a + m]] if with_ids else []), *([place] if placed else [])) for n, (a, m) in enumerate(pieces_of(ids, capacity))]
                frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, *["_order"] * placed])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return docs.select("doc_id", "text", *own).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", _order long" * len(own))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, how many, first sequence, offset).

    Pieces of that length with rank r in [first rank, first rank + how many) go to sequence
    first sequence + (r - first rank), at offset.
    """
    plan, opened = [], 0
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> runs (first sequence, how many)
    rooms: list[int] = []  # keys of groups, sorted

    def put(room: int, first: int, n: int) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
        groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                took = min(n, left)
                if took < n:
                    groups[room].append((first + took, n - took))
                if not groups[room]:
                    del groups[room], rooms[at]
                plan.append((length, rank, took, first, capacity - room))
                if room > length:
                    put(room - length, first, took)
            else:
                fit = capacity // length
                took = max(1, left // fit)
                each = fit if left >= fit else left
                for k in range(each):
                    plan.append((length, rank + k * took, took, opened, k * length))
                if capacity > each * length:
                    put(capacity - each * length, opened, took)
                opened += took
                took *= each
            left -= took
            rank += took
    return plan


def order_bucket(pieces: DataFrame, order: str):
    """Column: one of BUCKETS ranges of the values of order, which are from 0 on."""
    most = pieces.agg(F.max(order)).first()[0] or 0
    return F.floor(F.col(order) * F.lit(BUCKETS) / F.lit(most + 1))


def assigned(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (stashed by the caller) with sequence_id and offset; by _order, if there is one, pieces of a length are seated."""
    by_order = ["_order"] * ("_order" in pieces.columns)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS))
    if by_order:
        bucket = order_bucket(pieces, "_order")
    dealt = pieces.withColumn("_bucket", bucket.cast("int"))
    # At most capacity * BUCKETS rows.
    counts = sorted(((r[0], r[1], r[2]) for r in dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1))).collect()))
    histogram: dict[int, int] = defaultdict(int)
    base = {}
    for length, bucket, n in counts:
        base[length, bucket] = histogram[length]
        histogram[length] += n
    by_length: dict[int, list] = defaultdict(list)
    for length, rank, _, first, offset in sorted(best_fit(histogram, capacity)):
        by_length[length].append((rank, first, offset))
    plan = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in by_length.items()}
    sent = pieces.sparkSession.sparkContext.broadcast((base, plan))
    ranked = partial_ranks(dealt, ["length"], "_bucket", [*by_order, "doc_id", "piece", "start", "ids_crc32"])
    names = pieces.columns

    def seat(batches):
        base, plan = sent.value
        for pdf in batches:
            length = pdf["length"].to_numpy()
            rank = pdf["_local"].to_numpy() + np.fromiter((base[k] for k in zip(length.tolist(), pdf["_bucket"].tolist())), np.int64, len(pdf))
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, first, place = plan[int(n)]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at], offset[at] = first[k] + rank[at] - ranks[k], place[k]
            out = pdf[names].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["sequence_id"], out["offset"] = sequence, offset
            yield out

    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInPandas(seat, f"{kinds}, sequence_id long, offset long")


def in_order(seated: DataFrame) -> DataFrame:
    """seated with its sequences numbered by the _order of their first pieces."""
    seated = stash(seated, "seated")
    heads = seated.where("offset = 0").select("sequence_id", "_order").withColumn("_bucket", order_bucket(seated, "_order").cast("int"))
    base, at = [], 0
    # At most BUCKETS rows.
    for bucket, n in sorted(tuple(r) for r in heads.groupBy("_bucket").agg(F.count(F.lit(1))).collect()):
        base.append((bucket, at))
        at += n
    base = seated.sparkSession.createDataFrame(base, "_bucket int, _base long")
    ranked = partial_ranks(heads, [], "_bucket", ["_order", "sequence_id"]).join(F.broadcast(base), "_bucket")
    named = ranked.select("sequence_id", (F.col("_base") + F.col("_local")).cast("long").alias("_number"))
    names = [c for c in seated.columns if c != "_order"]
    return seated.join(named, "sequence_id").select(*[F.col("_number").alias(c) if c == "sequence_id" else F.col(c) for c in names])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset.

    With order, a column of places from 0 on, pieces of a length are seated and sequences numbered by it.
    """
    out = assigned(stash(tokenized(docs, path or default_path(), capacity, end, with_ids, order), "pieces"), capacity)
    return out if order is None else in_order(out)


def op8_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
