"""Mixing sources to target weights by Pfair scheduling.

A source of integer weight a among active weights of sum q owns a of every q slots. Its i-th block (from 1) may run
from slot (i - 1) * q // a on and has to run before slot ceil(i * q / a); among the blocks that may run, the one with
the earliest deadline does. With these windows a source is never a whole block away from its share. The schedule
repeats after q slots, so it is planned for one period only, and a block's slot follows from its number. When a
source runs out, a new phase begins among the others, in the same way; every row is placed, whatever the weights.

Rows of a source are in the order of md5(doc_id), a fixed shuffle that SQL can repeat. Ranks come from ranks within
(source, first two or three hex digits) and the counts of those, so a source with most rows is not gathered in one task.
What the driver plans is bounded by the weights: sources times their sum.

Cases: a null source and sources without a weight share one stream, `other`; a null doc_id counts as the text
`null`; rows of equal doc_id follow each other in any order; an empty table gives an empty result; `mixed` keeps all
columns of its input under their names, and names its own so that none clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import table

#: Blocks of each source in every 60; `other` is for all the rest.
WEIGHTS = {"src0": 10, "src1": 6, "src2": 6, "src3": 4, "src4": 4} | {f"src{k}": 2 for k in range(5, 19)} | {"src19": 1, "other": 1}
BLOCK = 16
#: Rows of one source that one task ranks, as long as 4,096 buckets do.
BUCKET_ROWS = 1_000_000


def period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline among released blocks."""
    q, done, slots = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(q):
        ready = [(-(-(done[s] + 1) * q // a), s) for s, a in weights.items() if done[s] < a and done[s] * q // a <= t]
        slots.append(min(ready)[1])
        done[slots[-1]] += 1
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[tuple[int, dict[str, int], list[str]]]:
    """(first slot, blocks that each active source has used before, its period) until all blocks are placed."""
    out, start, used = [], 0, dict.fromkeys(weights, 0)
    while active := {s: a for s, a in weights.items() if used[s] < blocks.get(s, 0)}:
        slots = period(active)
        out.append((start, {s: used[s] for s in active}, slots))
        places = {s: [t for t, x in enumerate(slots) if x == s] for s in active}
        last = lambda s: (blocks[s] - used[s] - 1) // active[s] * len(slots) + places[s][(blocks[s] - used[s] - 1) % active[s]]
        whole, rest = divmod(min(map(last, active)) + 1, len(slots))
        for s in active:
            used[s] += whole * active[s] + sum(t < rest for t in places[s])
        start += whole * len(slots) + rest
    return out


def free_prefix(docs: DataFrame, prefix: str = "mix_") -> str:
    """prefix, after as many underscores as it takes for no column of docs to begin so."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """docs with mix_stream, mix_block (within its stream), mix_slot and mix_position (the row's place in the mix).

    Where docs has a column that begins with mix_, the new ones begin with free_prefix(docs).
    """
    prefix = free_prefix(docs)
    spark = docs.sparkSession
    named = [s for s in weights if s != "other"]
    weights = {"other": 1} | weights
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    light = docs.select("doc_id", F.when(F.col("source").isin(named), F.col("source")).otherwise("other").alias("_stream"), md5.alias("_md5"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # At most 256 rows for each weight; where a bucket would be too much for one task, 4,096.
    for digits in (2, 3):
        light = light.withColumn("_bucket", F.substring("_md5", 1, digits))
        counts = sorted(tuple(r) for r in light.groupBy("_stream", "_bucket").agg(F.count(F.lit(1))).collect())
        if max([n for _, _, n in counts], default=0) <= BUCKET_ROWS:
            break
    rows, base = dict.fromkeys(weights, 0), []
    for s, b, n in counts:
        base.append((s, b, rows[s]))
        rows[s] += n
    blocks = {s: -(-n // block) for s, n in rows.items() if n}
    plan = phases(weights, blocks)
    starts = [(s, [p[1][s] for p in plan if s in p[1]]) for s in blocks]
    turns, slot_of = [], {}
    for k, (start, used, slots) in enumerate(plan):
        for s in used:
            places = [t for t, x in enumerate(slots) if x == s]
            turns += [(s, k, j, start + t, used[s], len(places), len(slots)) for j, t in enumerate(places)]
            slot_of[s] = lambda i, start=start, n0=used[s], places=places, q=len(slots): start + (i - n0) // len(places) * q + places[(i - n0) % len(places)]
    # The last block of a source may be short: later rows move up by what it lacks.
    short = sorted((slot_of[s](blocks[s] - 1), blocks[s] * block - rows[s]) for s in blocks if rows[s] % block)
    base = spark.createDataFrame(base, "_stream string, _bucket string, _base long")
    starts = spark.createDataFrame(starts, "_stream string, _starts array<long>")
    turns = spark.createDataFrame(turns, "_stream string, _phase int, _turn long, _first long, _used long, _each long, _period long")
    window = Window.partitionBy("_stream", "_bucket").orderBy("_md5", "doc_id", F.xxhash64("_row"))
    ranked = light.withColumn("_local", F.row_number().over(window) - 1).join(F.broadcast(base), ["_stream", "_bucket"]).join(F.broadcast(starts), "_stream")
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_local")).withColumn("_block", F.expr(f"_rank div {block}"))
    ranked = ranked.withColumn("_phase", F.size(F.filter("_starts", lambda x: x <= F.col("_block"))) - 1)
    each = turns.select("_stream", "_phase", "_used", "_each", "_period").distinct()
    placed = ranked.join(F.broadcast(each), ["_stream", "_phase"]).withColumn("_turn", F.expr("(_block - _used) % _each"))
    placed = placed.join(F.broadcast(turns.select("_stream", "_phase", "_turn", "_first")), ["_stream", "_phase", "_turn"])
    placed = placed.withColumn("_slot", F.expr("_first + (_block - _used) div _each * _period"))
    lacks = F.lit(0)
    for slot, n in short:
        lacks = lacks + F.when(F.col("_slot") > slot, n).otherwise(0)
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("_stream").alias(f"{prefix}stream"), F.col("_block").alias(f"{prefix}block"), F.col("_slot").alias(f"{prefix}slot"), (F.col("_slot") * block + F.expr(f"_rank % {block}") - lacks).cast("long").alias(f"{prefix}position"))


def in_order(docs: DataFrame, weights: dict[str, int] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """docs, dealt and sorted so that files read one after the other give the mix."""
    n, place = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), free_prefix(docs) + "position"
    return mixed(docs, weights, block).repartitionByRange(n, place).sortWithinPartitions(place).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_pfair_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "mix_stream", "mix_block", "mix_slot", "mix_position")


#: Slot by slot in a recursion over lists, a place for each source in the order of names: blocks done in the phase, blocks left, taking part.
OP1_SQL = """
with recursive w(s, a) as (values ('other', 1), ('src0', 10), ('src1', 6), ('src2', 6), ('src3', 4), ('src4', 4), ('src5', 2), ('src6', 2), ('src7', 2), ('src8', 2), ('src9', 2),
    ('src10', 2), ('src11', 2), ('src12', 2), ('src13', 2), ('src14', 2), ('src15', 2), ('src16', 2), ('src17', 2), ('src18', 2), ('src19', 1)),
d as (select doc_id, source, case when source in (select s from w) then source else 'other' end as s, md5(coalesce(doc_id::varchar, 'null')) as h from documents),
r as (select *, row_number() over (partition by s order by h, doc_id) - 1 as k from d),
n as (select s, (count(*) + 15) // 16 as blocks from r group by s),
src as (select list(s order by s) as names, list(a order by s) as aa, list(coalesce(blocks, 0) order by s) as bb, range(1, count(*) + 1) as places from w left join n using (s)),
run(slot, t, done, remain, active, pick) as (
  select -1::bigint, 0::bigint, list_transform(bb, lambda x: 0::bigint), list_transform(bb, lambda x: x::bigint), list_transform(bb, lambda x: x > 0), 0::bigint from src
  union all
  select slot + 1, t + 1, list_transform(places, lambda i: done[i] + (i = pick)::bigint), list_transform(places, lambda i: remain[i] - (i = pick)::bigint), active, pick
  from (select *, list_min(list_transform(list_filter(places, lambda i: active[i] and done[i] * q // aa[i] <= t), lambda i: ((done[i] + 1) * q + aa[i] - 1) // aa[i] * 1000 + i))::bigint % 1000 as pick
    from (select *, list_sum(list_transform(places, lambda i: case when active[i] then aa[i] else 0 end))::bigint as q
      from (select slot, remain, aa, places, case when ended then 0 else t end as t, case when ended then list_transform(done, lambda x: 0::bigint) else done end as done,
          case when ended then list_transform(remain, lambda x: x > 0) else active end as active
        from (select run.*, aa, places, len(list_filter(places, lambda i: active[i] and remain[i] = 0)) > 0 as ended from run, src where list_sum(remain) > 0))))),
b as (select names[pick] as s, slot, row_number() over (partition by pick order by slot) - 1 as block from run, src where pick > 0)
select doc_id, source, s as mix_stream, block::bigint as mix_block, slot as mix_slot, (row_number() over (order by slot, k) - 1)::bigint as mix_position
from r join b using (s) where r.k // 16 = b.block
"""
