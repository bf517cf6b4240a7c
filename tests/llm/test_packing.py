import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import empty_docs, odd_docs, odd_rows
from tidemark.llm import packing


def ids_by_file(t):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_path()).encode(t or "", add_special_tokens=False).ids + [2]


def check(rows, capacity):
    """Gapless sequences, none over capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_those_of_the_file():
    pytest.importorskip("public_tokenizers")
    texts = [r[1] or "" for r in odd_rows() if not r[1] or len(r[1]) < 9000]
    texts += ["it's we'LL  x \n\n y\t", "１２３ ⅷ ²,  　 a‍b", "a<|endoftext|>b <|end", "\U0001f468‍\U0001f469 naïve", " ", "\n", "éé" * 300, "aaaa" * 500]
    r = random.Random(4)
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x2FF), r.randrange(0x4E00, 0x4F00), 9, 10, 32])) for _ in range(200)) for _ in range(200)]
    got = packing.encoder(packing.default_path())(texts)
    assert [g + [2] for g in got] == [ids_by_file(t) for t in texts]


def test_pieces():
    assert packing.pieces_of([0] * 10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.pieces_of([0] * 8, 4) == [(0, 4), (4, 4)]
    assert packing.pieces_of([0] * 4, 4) == [(0, 4)] and packing.pieces_of([0], 4) == [(0, 1)]


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 64), r.randint(1, 8), 64, 33]) for _ in range(700)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit(histogram, 64)
    rows = [{"sequence_id": first + k, "offset": offset, "length": n} for n, _, many, first, offset in plan for k in range(many)]
    assert len(rows) == len(lengths)
    for n in histogram:
        ranks = sorted(rank + k for m, rank, many, _, _ in plan if m == n for k in range(many))
        assert ranks == list(range(histogram[n]))
    assert check(rows, 64) == one_by_one(lengths, 64)


def test_whole_packing(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, capacity=64, with_ids=True).collect()
    check(rows, 64)
    whole = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        whole.setdefault(r["doc_id"], {})[r["piece"]] = (r["start"], r["ids"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, parts in whole.items():
        ids = []
        for k in sorted(parts):
            assert parts[k][0] == len(ids)
            ids += parts[k][1]
        assert ids == ids_by_file(texts[d])
    assert len([r for r in rows if r["doc_id"] == 2 and r["piece"] == 0]) == 2
    assert packing.pack(empty_docs(spark)).count() == 0
