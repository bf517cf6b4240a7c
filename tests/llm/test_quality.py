import re
from collections import Counter

import duckdb

from tests.compare import difference
from tests.llm.helpers import empty_docs, odd_docs, odd_rows, text
from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def texts():
    return [r[1] for r in odd_rows()] + ["a b c a b c", "a b c d a b c", "x\ny\nx\nx\n", "a a a a a a", " x ", text(4, 30) + " " + text(4, 30), "w " * 60]


def test_counts_match_brute_force(spark):
    rows = list(enumerate(texts()))
    got = quality.counts(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("f", quality.base_failed()).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["f"]) for r in got} == {k: brute(t) for k, t in rows}


def test_em_finds_accuracies():
    names = len(quality.RULES)
    patterns = {tuple([2] * names): 900, tuple([0] + [2] * (names - 1)): 5, tuple([0, 0, 0] + [1] * (names - 3)): 95}
    prior, probs = quality.fit(patterns)
    assert 0.85 < prior < 0.96
    post = {p: quality.posterior(p, prior, probs) for p in patterns}
    assert post[tuple([2] * names)] > 0.99 and post[tuple([0, 0, 0] + [1] * (names - 3))] < 0.01


def test_verdict_is_the_posterior_of_the_votes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts() * 3)], "doc_id long, text string")
    rows = quality.quality_report(docs).collect()
    names = [f"vote_{r[0]}" for r in quality.RULES]
    patterns = Counter(tuple(r[n] for n in names) for r in rows)
    prior, probs = quality.fit(dict(patterns))
    for r in rows:
        p = quality.posterior(tuple(r[n] for n in names), prior, probs)
        assert abs(p - r["p_good"]) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.3)


def test_odd_cases_and_columns_stay(spark):
    docs = odd_docs(spark)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    report = quality.quality_report(docs)
    assert report.count() == docs.count()
    want = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got and not got - want
    assert all(r["n_words"] == "own n_words" for r in kept.collect())
    assert quality.quality_report(empty_docs(spark)).count() == 0 and quality.quality_filter(empty_docs(spark)).count() == 0


def test_junk_goes_and_clean_stays(spark):
    clean = [(i, text(i, 150, 2)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "***$$$" for w in text(i, 150).split())) for i in range(8)]
    kept = {r["doc_id"] for r in quality.quality_filter(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in clean}


def test_sql_gives_the_same_verdicts(spark, tmp_path):
    odd_docs(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(spark, con, str(tmp_path), quality.op5_quality_rules, quality.OP5_SQL) == ""
