"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of one document and votes good, bad or abstains. A latent-class model (one hidden quality
bit, votes independent given it) is fitted by expectation-maximisation on the number of documents by vote pattern:
at most 3 ** rules rows, whatever the size of the corpus. A document is kept if its posterior probability of being
good reaches the threshold and it does not fail the base rules.

Only DataFrame functions run on the executors. Cases: null and empty texts have no words and fail the base rules;
repeated rows and tied votes get equal verdicts each; an empty table gives an empty result; only doc_id and text are
read, so other columns may have any name (`quality_filter` returns them unchanged).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stash, table, words

SYMBOLS = "#*$%&|<>"
STOPWORDS = sorted(set(
    "the of and to in is a that for it with as was on be by are this or from at an "
    "der die das und ist in zu den mit von ein eine im auf für nicht dem des sich als "
    "le la les des et de un une du est que qui en dans pour par sur au pas avec "
    "el los las del y se por con su para al es lo como más una"
    .split()))

#: The least posterior probability of being good. Under a half, as rules vote on one text together more often than the
#: model thinks (votes count as independent given quality), which drives posteriors to the ends: doubt keeps a document.
THRESHOLD = 0.3

#: name, vote good if, vote bad if; SQL over the counts. Neither: the rule abstains.
RULES = [
    ("length", "n_words >= 100", "n_words < 20"),
    ("repetition", "n_repeat_words < 0.1 * n_words", "n_repeat_words > 0.4 * n_words"),
    ("lines", "n_dup_lines = 0", "n_dup_lines > 0.3 * n_lines"),
    ("symbols", "n_symbols <= 0.02 * word_chars", "n_symbols > 0.1 * word_chars"),
    ("capitals", "n_upper <= 0.1 * word_chars", "n_upper > 0.4 * word_chars"),
    ("shouting", "n_shouts <= 0.02 * n_words", "n_shouts > 0.2 * n_words"),
    ("stopwords", "n_stopwords >= 0.1 * n_words", "n_stopwords < 0.02 * n_words"),
    ("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars > 12 * n_words or word_chars < 2 * n_words"),
]


def counts(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, the named extra columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' other counts."""
    keep = ["doc_id", *extra]
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    one = docs.select(*keep, text.alias("_t"), words(F.col("text")).alias("_w"))
    text = F.col("_t")
    two = one.select(
        *keep, "_w",
        (F.length(text) - without(" \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        without("!").cast("long").alias("n_shouts"),
        F.size(F.filter("_w", lambda w: w.isin(STOPWORDS))).cast("long").alias("n_stopwords"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    rest = ["word_chars", "n_symbols", "n_upper", "n_shouts", "n_stopwords"]
    three = two.select(
        *keep, *rest,
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        # Windows sorted by hash and place, but only where some window repeats at all.
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    rest += ["n_words", "n_lines", "n_dup_lines"]
    equal = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    four = three.select(*keep, *rest, F.sort_array(F.transform(F.filter("_s", lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"])).alias("_r"))
    covered = F.aggregate(F.transform("_r", lambda i, k: F.least(F.lit(3), F.coalesce(i - F.get("_r", k - 1), F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return four.select(*keep, *rest, covered.cast("long").alias("n_repeat_words"))


def vote_columns() -> list[Column]:
    """One integer column by rule: 2 good, 0 bad, 1 abstains."""
    return [F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1).alias(f"vote_{name}") for name, good, bad in RULES]


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 60, floor: float = 0.5) -> tuple[float, list[list[list[float]]]]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the share of good documents and, by rule, the probability of each vote given bad and given good. Starts
    from the all-must-pass filter (any bad vote: probably bad), so the classes keep their meaning. floor is the
    pseudo-count of a vote.
    """
    m = len(RULES)
    rows = sorted(patterns.items())
    post = [0.1 if 0 in p else 0.95 for p, _ in rows]
    prior, probs = 0.5, [[[1 / 3] * 3, [1 / 3] * 3] for _ in range(m)]
    for _ in range(rounds):
        good = sum(n * g for (_, n), g in zip(rows, post))
        total = sum(n for _, n in rows)
        prior = min(0.999, max(0.001, (good + 1) / (total + 2)))
        probs = []
        for j in range(m):
            tally = [[floor] * 3, [floor] * 3]
            for (p, n), g in zip(rows, post):
                tally[1][p[j]] += n * g
                tally[0][p[j]] += n * (1 - g)
            probs.append([[x / sum(t) for x in t] for t in tally])
        post = [posterior(p, prior, probs) for p, _ in rows]
    return prior, probs


def posterior(votes: tuple[int, ...], prior: float, probs: list) -> float:
    logit = math.log(prior / (1 - prior)) + sum(math.log(q[1][v] / q[0][v]) for v, q in zip(votes, probs))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def judged(features: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """features (counts(); it is read twice) with the votes, base_failed, p_good and kept."""
    names = [f"vote_{r[0]}" for r in RULES]
    voted = features.select("*", *vote_columns())
    # At most 3 ** len(RULES) rows reach the driver.
    patterns = {tuple(r[n] for n in names): r["n"] for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    prior, probs = fit(patterns)
    logit = F.lit(math.log(prior / (1 - prior)))
    for name, q in zip(names, probs):
        logit = logit + F.element_at(F.array(*[F.lit(math.log(q[1][v] / q[0][v])) for v in range(3)]), F.col(name) + 1)
    scored = voted.withColumn("base_failed", base_failed()).withColumn("p_good", 1 / (1 + F.exp(-logit)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, the votes, base_failed, p_good and kept."""
    return judged(stash(counts(docs.select("doc_id", "text")), "quality"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("text"))
    # Written with the rows: votes over unwritten counts become one expression that the optimizer does not get through.
    kept = judged(stash(counts(own, ["_row"]), "quality-rows")).where("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op5_quality_rules(spark, sf_dir):
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


#: The rules' counts by windows of rows, and expectation-maximisation as a recursion over lists, a place for each pattern of votes.
OP5_SQL = rf"""
with recursive w as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
win as (select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as found from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
cover as (select r, count(distinct i + o) as n from win, (values (0), (1), (2)) as s(o) where found > 1 group by r),
c as materialized (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as n_upper, length(t) - length(replace(t, '!', '')) as n_shouts,
    len(list_filter(ws, lambda x: x in ({", ".join(f"'{x}'" for x in STOPWORDS)}))) as n_stopwords,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from w left join cover using (r)),
v as materialized (select *, [
    case when n_words < 20 then 0 when n_words >= 100 then 2 else 1 end,
    case when n_repeat_words > 0.4 * n_words then 0 when n_repeat_words < 0.1 * n_words then 2 else 1 end,
    case when n_dup_lines > 0.3 * n_lines then 0 when n_dup_lines = 0 then 2 else 1 end,
    case when n_symbols > 0.1 * word_chars then 0 when n_symbols <= 0.02 * word_chars then 2 else 1 end,
    case when n_upper > 0.4 * word_chars then 0 when n_upper <= 0.1 * word_chars then 2 else 1 end,
    case when n_shouts > 0.2 * n_words then 0 when n_shouts <= 0.02 * n_words then 2 else 1 end,
    case when n_stopwords < 0.02 * n_words then 0 when n_stopwords >= 0.1 * n_words then 2 else 1 end,
    case when word_chars > 12 * n_words or word_chars < 2 * n_words then 0 when word_chars between 3 * n_words and 10 * n_words then 2 else 1 end] as votes from c),
p as (select list(votes order by votes) as pp, list(n order by votes) as nn, list((case when list_contains(votes, 0) then 0.1 else 0.95 end)::double order by votes) as g
  from (select votes, count(*)::double as n from v group by votes)),
em(k, g) as (
  select 0, g from p
  union all
  select k + 1, list_transform(pp, lambda x: 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 9), lambda j: ln(good[j][x[j] + 1] / list_sum(good[j]) / (bad[j][x[j] + 1] / list_sum(bad[j])))))))))
  from (select k, pp, least(0.999, greatest(0.001, (list_sum(list_transform(nn, lambda n, i: n * g[i])) + 1) / (list_sum(nn) + 2)))::double as prior,
      list_transform(range(1, 9), lambda j: list_transform([0, 1, 2], lambda vote: 0.5::double + list_sum(list_transform(nn, lambda n, i: case when pp[i][j] = vote then n * g[i] else 0 end)))) as good,
      list_transform(range(1, 9), lambda j: list_transform([0, 1, 2], lambda vote: 0.5::double + list_sum(list_transform(nn, lambda n, i: case when pp[i][j] = vote then n * (1 - g[i]) else 0 end)))) as bad
    from (select k, em.g, pp, nn from em, p where k < 60))),
post as (select unnest(pp) as votes, unnest(em.g) as g from em, p where k = 60)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and g >= 0.3 as kept, round(g, 6) as p_good
from v join post using (votes)
"""
