import random
import zlib
from array import array

import duckdb
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import WORDS, empty_docs, odd_docs, text
from tests.llm.test_line_dedup import brute
from tidemark.llm import line_dedup, mixing, packing, registry


def run(spark, docs, tmp_path):
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append((name, docs))
    return out


def test_stages(spark, tmp_path):
    docs = odd_docs(spark)
    stages = run(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for _, d in stages[:-1])
    kept, lines, once, mixed = (d.collect() for _, d in stages[:-1])
    assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in docs.collect()} and 10 not in {r["doc_id"] for r in kept}
    assert len(lines) == len(kept) and len(mixed) == len(once) < len(lines)
    pieces = stages[-1][1].groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed}


def test_run_from_files(spark, tmp_path):
    rows = [(k, text(k % 30, 90, 2), "en", f"src{k % 3}") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= set(range(30)) and len({r["doc_id"] for r in out}) <= 31


def test_empty(spark, tmp_path):
    assert all(d.count() == 0 for _, d in run(spark, empty_docs(spark), tmp_path))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_sequences_are_in_the_order_of_the_mix(spark, tmp_path):
    rows = [(k, text(k, 700), "en", f"src{k % 3}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    place = {r["doc_id"]: r["mix_position"] for r in mixing.mixed(docs).collect()}
    heads = [r for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect() if r["offset"] == 0]
    assert sorted(r["sequence_id"] for r in heads) == list(range(len(heads)))
    in_mix = [place[r["doc_id"]] for r in sorted(heads, key=lambda r: r["sequence_id"])]
    assert in_mix == sorted(in_mix)


def corpus(seed: int) -> list[tuple]:
    """Clean documents, exact and near copies, shared lines, bad ones and a very long one."""
    r = random.Random(seed)
    shared = [text(900 + k, 12) for k in range(3)]
    rows = []
    for k in range(70):
        words = text(k, r.randint(70, 400)).split()
        lines = [" ".join(words)] + r.sample(shared, r.randrange(3)) + [f"own line {k * 7919} {r.choice(WORDS)} and nothing else in it"]
        rows.append((k, "\n".join(lines), f"src{r.choice([0, 0, 0, 1, 2, 3, 30])}"))
    for k in range(70, 90):
        words = rows[r.randrange(70)][1].split("\n")[0].split()
        words[r.randrange(len(words))] = f"Zxqv{k}Zxqv"
        rows.append((k, " ".join(words), r.choice(["src1", "src4", None])))
    rows += [(k, rows[k % 70][1], "src5") for k in range(90, 96)]
    rows += [(96, "###*** %%% &&& " * 60, "src0"), (97, "BUY NOW!!! " * 80, "src1"), (98, "too short", "src2"), (99, None, None), (100, " ".join(f"the {w} of{k}" for k, w in enumerate(text(5000, 3000).split())), "src0")]
    r.shuffle(rows)
    return rows


def sql(query: str, rows: list[tuple]) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    return con.execute(query).df()


def by_hand(rows: list[tuple]) -> tuple[list[tuple], dict[int, int]]:
    """The documents that the first three stages keep, and their places in the mix: SQL, sets of shingles, SQL."""
    kept = set(sql(registry.ORACLE["op5_quality_rules"], rows).query("kept").doc_id)
    rows = [r for r in rows if r[0] in kept]
    stays = {(r.doc_id, r.line_no) for r in sql(registry.ORACLE["op7_line_dedup"], rows).itertuples() if r.kept}
    rows = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) in stays), s) for d, t, s in rows]
    sets = {}
    for d, t, _ in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    near = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    while any(label[a] != label[b] for a, b in near):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    rows = [r for r in rows if label[r[0]] == r[0]]
    mix = sql(registry.ORACLE["op1_pfair_mix"], rows)
    return rows, dict(zip(mix.doc_id, mix.mix_position))


def test_run_against_brute_force(spark, tmp_path):
    rows = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, place = by_hand(rows)
    assert 40 < len(want) < 90 and 100 in place
    encode, pieces = Tokenizer.from_file(packing.default_path()), set()
    for d, t, _ in want:
        ids = [*encode.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        pieces |= {(d, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out} == pieces and len(out) == len(pieces)
    sequences = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 1024
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    rooms = []
    for n in sorted((p[3] for p in pieces), reverse=True):
        best = min((x for x in rooms if x >= n), default=None)
        rooms.append((1024 if best is None else rooms.pop(rooms.index(best))) - n)
    assert len(sequences) <= len(rooms)
    heads = [place[r["doc_id"]] for r in sorted(out, key=lambda r: r["sequence_id"]) if r["offset"] == 0]
    assert heads == sorted(heads)


def test_the_line_stage_verifies_few_pairs_of_near_copies(spark, monkeypatch):
    """Lines that share segments but are mostly four to eight edits apart: hardly a pair is verified, the right ones fall."""
    r, base = random.Random(4), text(4, 50)[:45]
    docs = [(k, base[:at] + "".join(r.choice("bcdfgklmpuvwy") for _ in range(4)) + base[at:]) for k, at in enumerate(r.choices(range(8), k=90))]
    met, kept = {}, line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name: met.setdefault(name, kept(df, name)))
    monkeypatch.setattr(line_dedup, "drop", lambda *dfs: None)
    out = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.select("doc_id", "text").collect())) == [(d, x if v[3] else "") for (d, x), v in zip(docs, brute(docs, 2, 6).values())]
    assert met["line-pairs"].count() <= 1000
