import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tests.compare import difference
from tests.llm.helpers import empty_docs, odd_docs, text
from tidemark.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[k] = r.choice("abcdefghijklmnop é漢")
        elif kind == 1:
            s.insert(k, r.choice("xyz é"))
        elif len(s) > 1:
            del s[k]
    return "".join(s)


def brute(docs, edits, min_chars):
    lines = [(d, k, x) for d, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    first = {}
    for d, k, x in sorted(lines, key=lambda r: r[:2]):
        if len(x) >= min_chars and x.strip(" \t\r\x0b\x0c"):
            first.setdefault(x, (d, k))
    names = list(first)
    near = {x: [y for y in names if x != y and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits] for x in names}
    label = dict(first)
    while True:
        new = {x: min([label[x]] + [label[y] for y in near[x]]) for x in names}
        if new == label:
            break
        label = new
    return {(d, k): (*label.get(x, (d, k)), len(near.get(x, ())), label.get(x, (d, k)) == (d, k)) for d, k, x in lines}


def sample(seed, n=24):
    r = random.Random(seed)
    base = [text(seed * 100 + k, r.randint(4, 9)) for k in range(8)] + ["漢字" * 11, "a" * 25, "ab" * 14]
    docs = []
    for d in range(n):
        docs.append((d, "\n".join(edited(r, r.choice(base), r.choice([0, 0, 1, 1, 2, 3])) if r.random() < 0.8 else r.choice(["", "  ", "short"]) for _ in range(6))))
    return docs + [(n, None), (n + 1, "")]


def test_classes_match_brute_force(spark):
    for seed, edits in ((1, 2), (2, 1), (3, 3), (4, 2)):
        docs = sample(seed)
        got = ld.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), edits, 20).collect()
        got = {(r["doc_id"], r["line_no"]): (int(r["class_place"]) // ld.PLACE, int(r["class_place"]) % ld.PLACE, r["n_links"], r["kept"]) for r in got}
        assert got == brute(docs, edits, 20)


def test_text_keeps_first_lines(spark):
    docs = sample(7)
    want = brute(docs, 2, 20)
    got = {r["doc_id"]: r["text"] for r in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if want[d, k][3]) for d, t in docs}


def test_odd_cases(spark):
    docs = odd_docs(spark)
    out = ld.line_dedup(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in docs.collect())
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[1] == text(1, 80) and by[2] == "" and by[4] is None and by[13] == ""
    assert ld.line_dedup(empty_docs(spark)).count() == 0 and ld.line_classes(empty_docs(spark)).count() == 0


def test_short_lines_of_the_query(spark, tmp_path):
    docs = [(1, "Read more\nabc\n\nAll rights reserved"), (2, "Read more\nabd\n\nAll rights reserve"), (3, "Raed more\nabc\n\nown")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["n_links"], r["kept"]) for r in ld.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[d, 0] for d in (1, 2, 3)] == [(1, 1, True), (1, 1, False), (1, 1, False)]
    assert [got[d, 1] for d in (1, 2, 3)] == [(1, 0, True), (2, 0, True), (1, 0, False)]
    assert [got[d, 2][2] for d in (1, 2, 3)] == [True] * 3 and got[2, 3] == (1, 1, False) and got[3, 3] == (3, 0, True)


def test_negative_and_null_ids(spark, tmp_path):
    line = "a line of some length that repeats"
    docs = [(-5, f"own text number one of five\n{line}"), (3, f"{line}!"), (None, line), (None, f"only here, without an id\n{line}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["line_no"], r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in ld.op7_line_dedup(spark, str(tmp_path)).collect())
    assert got == Counter([(-5, 0, -5, 0, 0, True), (-5, 1, -5, 1, 1, True), (3, 0, -5, 1, 1, False), (None, 0, -5, 1, 1, False), (None, 0, None, 0, 0, True), (None, 1, -5, 1, 1, False)])


def test_hot_lines_and_shared_segments(spark, monkeypatch):
    """Lines of very many copies are told by broadcast, and the result is the same."""
    from tidemark.llm import _common

    docs = sample(11, 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 2, 20)
    monkeypatch.setattr(_common, "HOT_ROWS", 1)
    monkeypatch.setattr(_common, "HOT_KEYS", 1 << 40)
    got = ld.line_classes(frame, 2, 20).collect()
    assert {(r["doc_id"], r["line_no"]): (int(r["class_place"]) // ld.PLACE, int(r["class_place"]) % ld.PLACE, r["n_links"], r["kept"]) for r in got} == want


def test_every_window_is_probed():
    """For lines a and b within the edits, some own piece of the shorter is a piece of the longer."""
    r = random.Random(5)

    def pieces(x, edits, own):
        base, rest = divmod(len(x), edits + 1)
        return {(i, x[i * base + off : i * base + off + base + more]) for i, by in enumerate(ld.windows(edits)) for off, more in (by[rest][:1] if own else by[rest])}

    for edits in (1, 2, 3):
        for _ in range(2000):
            a = "".join(r.choice("ab") for _ in range(r.randint(2 * edits + 2, 30)))
            b = edited(r, a, r.randint(0, edits))
            a, b = sorted((a, b), key=len)
            if len(a) > 2 * edits + 1 and distance(a, b) <= edits:
                assert pieces(a, edits, True) & pieces(b, edits, False)


def test_sql_gives_the_same_lines(spark, tmp_path):
    rows = sample(7, 60) + [(-5, sample(7)[3][1] + "\n Read more\nRead more\r"), (None, sample(7)[4][1]), (3, sample(7)[3][1]), (-5, "abcdef\nabcdeé\nab\nab\n漢字漢字漢字x\n漢字漢字漢字")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(spark, con, str(tmp_path), ld.op7_line_dedup, ld.OP7_SQL) == ""


def test_few_pairs_are_verified_in_a_group_of_near_copies(spark, monkeypatch):
    """Lines that share two of three segments but are three to eight edits apart hardly meet; no pair within the edits is lost."""
    r, base = random.Random(4), text(4, 50)[:45]
    lines = [base[:at] + "".join(r.choice("bcdfgklmpuvwy") for _ in range(4)) + base[at:] for at in r.choices(range(8), k=90)]
    docs = list(enumerate([*lines, *(edited(r, x, 2) for x in lines[:10])]))
    met, kept = {}, ld.stash
    monkeypatch.setattr(ld, "stash", lambda df, name: met.setdefault(name, kept(df, name)))
    monkeypatch.setattr(ld, "drop", lambda *dfs: None)
    got = ld.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), 2, 20).collect()
    assert {(x["doc_id"], x["line_no"]): (int(x["class_place"]) // ld.PLACE, int(x["class_place"]) % ld.PLACE, x["n_links"], x["kept"]) for x in got} == brute(docs, 2, 20)
    assert met["line-links"].count() == 30 and met["line-pairs"].count() <= 1000


def test_parities_lose_no_pair_within_the_edits(spark):
    r, rows = random.Random(6), []
    for _ in range(3000):
        a = "".join(r.choice("abé漢A ") for _ in range(r.randint(6, 40)))
        rows.append(tuple(sorted((a, edited(r, a, r.randint(0, 2))), key=len)))
    sides = "struct(length({0}) as n, {0}_par as par) as {0}"
    both = spark.createDataFrame(rows, "x string, y string").withColumns({f"{c}_par": ld.parities(F.col(c)) for c in "xy"})
    assert both.selectExpr(sides.format("x"), sides.format("y")).where(f"not ({ld.near_parities('x', 'y', 2)})").count() == 0
