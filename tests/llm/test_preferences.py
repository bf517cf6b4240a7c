import duckdb

from tidemark.llm import preferences

TURNS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hello"), (0, 2, "assistant", "hi <|end|> there"), (0, 3, "user", "more"), (0, 4, "assistant", "yes"),
    (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "go away"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, 0, "user", "alone"), (4, 1, "assistant", None),
    (7, 5, None, "odd"), (7, 5, None, "odd"), (7, None, "user", "first"),
    (8, 0, "user", "a"), (9, 0, "user", "b"), (8, 1, "assistant", "漢\U0001f600"), (9, 1, "assistant", ""),
    (None, 0, "user", "lost"),
]


def by_hand(turns):
    def show(ts):
        out, spans = "", []
        for role, t in ts:
            head, body = f"<|{role or 'unknown'}|>\n", (t or "").replace("<|", "<\\|") + "<|end|>\n"
            if role == "assistant":
                spans.append(f"{len(out) + len(head)}:{len(out) + len(head) + len(body)}")
            out += head + body
        return out, ",".join(spans)

    low = lambda x: (x is not None, x)
    sides = {}
    for c, n, role, t in sorted(turns, key=lambda r: tuple(map(low, r[1:]))):
        sides.setdefault(None if c is None else c // 2, ([], []))[0 if c is None or c % 2 == 0 else 1].append((role, t))
    out = {}
    for pair, (a, b) in sides.items():
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        out[pair] = (len(a), len(b), n, show(a[:n])[0], *show(a[n:]), *show(b[n:]))
    return out


def test_pairs_match_brute_force_and_sql(spark, tmp_path):
    names = ["pair_id", "n_chosen", "n_rejected", "n_prefix", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["pair_id"]: tuple(r[n] for n in names[1:]) for r in preferences.op4_preference_format(spark, str(tmp_path)).collect()}
    assert got == by_hand(TURNS)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    con.execute("create table told as " + preferences.OP4_SQL)
    assert {r[0]: tuple(r[1:]) for r in con.execute(f"select {', '.join(names)} from told").fetchall()} == got


def test_empty(spark):
    none = spark.createDataFrame([], "pair_id long, chosen boolean, turn long, role string, text string")
    assert preferences.format_preferences(none).count() == 0


def test_pairs_of_large_and_negative_ids(spark, tmp_path):
    ids = [2**60, 2**60 + 1, 2**60 + 2, -1, -2, -3]
    spark.createDataFrame([(k, 0, "user", f"t{k}") for k in ids], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["pair_id"]: (r["n_chosen"], r["n_rejected"]) for r in preferences.op4_preference_format(spark, str(tmp_path)).collect()}
    assert got == {2**59: (1, 1), 2**59 + 1: (1, 0), -1: (1, 1), -2: (0, 1)}
