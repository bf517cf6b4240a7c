"""Preference formatting: pairs of chosen and rejected conversations to prompt and masked completions.

The longest common prefix of turns (equal role and text, in order) is rendered once as the prompt. What follows in
either conversation is its completion; a loss mask names the spans of it (from:to in code points, end exclusive) that
the assistant wrote, with the closing mark. A turn renders as `<|role|>`, line end, text, `<|end|>`, line end; `<|`
within a text becomes `<\\|`, so no text can pretend to be a turn.

Only DataFrame functions run. A pair's turns are gathered in one row, as its rendering has to be. Cases: a missing
side has no turns, so the prompt is empty; identical conversations are all prompt; a null text is empty, a null role
is `unknown`; repeated turns stay, ordered by turn, role and text, nulls first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import table


def rendered(role: Column, text: Column) -> tuple[Column, Column]:
    """Opening mark and the rest of a turn."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n")), F.concat(F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n"))


def whole(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def mask(turns: Column) -> Column:
    """from:to of the assistant's parts of the rendering, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s, t):
        a = s["at"] + F.length(t["head"])
        b = a + F.length(t["body"])
        mine = F.array(F.concat_ws(":", a.cast("string"), b.cast("string")))
        return F.struct(b.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], mine)).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text. One row per pair: pair_id, n_chosen, n_rejected, n_prefix,
    prompt, chosen, chosen_mask, rejected, rejected_mask."""
    head, body = rendered(F.col("role"), F.col("text"))
    one = turns.select("pair_id", "chosen", F.struct("turn", "role", "text", head.alias("head"), body.alias("body")).alias("t"))
    side = lambda is_chosen: F.sort_array(F.collect_list(F.when(F.col("chosen") == F.lit(is_chosen), F.col("t"))))
    two = one.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    equal = lambda i: F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"])
    differ = F.when(shorter > 0, F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: ~equal(i)))
    three = two.withColumn("n", F.coalesce(F.get(differ, F.lit(0)), shorter))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    four = three.select("pair_id", F.size("c").cast("long").alias("n_chosen"), F.size("r").cast("long").alias("n_rejected"), F.col("n").cast("long").alias("n_prefix"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return four.select("pair_id", "n_chosen", "n_rejected", "n_prefix", whole(F.col("p")).alias("prompt"), whole(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), whole(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def op4_preference_format(spark, sf_dir):
    """Pairs of the whole table: an even conv_id is chosen, the odd one after it rejected."""
    turns = table(spark, sf_dir, "conversations")
    return format_preferences(turns.select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), F.coalesce(F.expr("conv_id % 2 = 0"), F.lit(True)).alias("chosen"), "turn", "role", "text"))


OP4_SQL = r"""
with t as (select (conv_id - (conv_id & 1)) // 2 as pair_id, coalesce(conv_id % 2 = 0, true) as is_chosen, role, text,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) as head, replace(coalesce(text, ''), '<|', '<\|') || '<|end|>' || chr(10) as body,
    row_number() over (partition by (conv_id - (conv_id & 1)) // 2, coalesce(conv_id % 2 = 0, true) order by turn nulls first, role nulls first, text nulls first) as k
  from conversations),
pairs as (select pair_id, count(*) filter (where is_chosen) as n_chosen, count(*) filter (where not is_chosen) as n_rejected from t group by pair_id),
bad as (select a.pair_id, min(a.k) as k from t a join t b on a.pair_id is not distinct from b.pair_id and a.k = b.k and a.is_chosen and not b.is_chosen
  where a.role is distinct from b.role or a.text is distinct from b.text group by a.pair_id),
n as (select p.*, coalesce(bad.k - 1, least(n_chosen, n_rejected)) as n_prefix from pairs p left join bad on p.pair_id is not distinct from bad.pair_id),
x as (select t.*, n.n_prefix, t.k > n.n_prefix as later, sum(length(head) + length(body)) over (partition by t.pair_id, is_chosen, t.k > n.n_prefix order by t.k) as ends
  from t join n on t.pair_id is not distinct from n.pair_id),
g as (select pair_id,
    coalesce(string_agg(head || body, '' order by k) filter (where is_chosen and not later), '') as prompt,
    coalesce(string_agg(head || body, '' order by k) filter (where is_chosen and later), '') as chosen,
    coalesce(string_agg((ends - length(body))::bigint || ':' || ends::bigint, ',' order by k) filter (where is_chosen and later and role = 'assistant'), '') as chosen_mask,
    coalesce(string_agg(head || body, '' order by k) filter (where not is_chosen and later), '') as rejected,
    coalesce(string_agg((ends - length(body))::bigint || ':' || ends::bigint, ',' order by k) filter (where not is_chosen and later and role = 'assistant'), '') as rejected_mask
  from x group by pair_id)
select n.pair_id, n_chosen, n_rejected, cast(n_prefix as bigint) as n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask
from n join g on n.pair_id is not distinct from g.pair_id
"""
