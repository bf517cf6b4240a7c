"""Line dedup across documents: exact lines by hash, nearly equal lines by a segment-partition edit join.

Lines are cut into k + 1 segments, so two lines within k edits share one. A line is indexed under its own segments and
probes, for every length from its own down to k less, the few places where a segment of a match can lie (the
multi-match-aware windows). A key hashes a segment and its number; as a segment's length follows from the line's,
windows of different lengths that name the same piece of the line are one key, and the join compares lengths.

Text is never shuffled or written but for lines that share a key with another. Documents are read for hashes and keys
of each line, summed by the line's 128-bit hash before the shuffle; keys of one line only are summed away next. The
join of what is left carries keys, line numbers, lengths, letter counts and parities of characters and of pairs of
neighbours, whose distances edits bound. What passes is verified by a banded bit-parallel edit automaton: 2k + 1
diagonals by k + 1 edit counts packed in one integer, moved on by each character.

Links make classes (connected components). In every class the first line, by (doc_id, line_no), stays.

The query and the pipeline's stage pass short: lines of every length take part, those too short for segments by hash.

Only DataFrame functions run on the executors. Cases: blank lines, null texts and, without short, shorter lines take
no part and stay; rows of one doc_id count as one document, so their equal lines of one number are one line; negative
doc_ids come first and a null one after all others; equal lines tie by position; an empty table gives an empty result;
`line_dedup` returns all columns under their names, with the lines removed from text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import components, drop, spread, stash, table

EDITS = 2
MIN_CHARS = 20
LETTERS = " etnioahrs"
#: A broadcast of keys or candidate lines up to this count (72 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Place of a line: doc_id * PLACE + line_no; a null doc_id counts as NO_ID, beyond all others.
PLACE, NO_ID = 2147483648, 9223372036854775808


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs' columns but text, with line_no, line, n, takes_part, two hashes of the line and its place."""
    rest = [c for c in docs.columns if c != "text"]
    one = docs.select(*rest, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)")) * PLACE + F.col("line_no")
    some = F.col("line").rlike(r"[^\x20\x09-\x0D]")
    return one.select("*", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), place.cast("decimal(32,0)").alias("place")).withColumn("takes_part", some & (F.col("n") >= min_chars))


def place_parts(place: Column) -> tuple[Column, Column]:
    """doc_id and line_no of a place."""
    line = F.pmod(place, F.lit(PLACE).cast("decimal(32,0)"))
    doc = F.when(place < F.lit(str(NO_ID * PLACE)).cast("decimal(32,0)"), F.call_function("div", place - line, F.lit(PLACE).cast("decimal(32,0)")))
    return doc.cast("long"), line.cast("int")


def signature(line: Column, n: Column) -> Column:
    """Counts of the LETTERS modulo 64, in six bits each."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        out = out.bitwiseOR(F.shiftleft((n - F.length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(63)).cast("long"), 6 * k))
    return out


def near_signatures(a: str, b: str, edits: int) -> str:
    """SQL: the letter counts of two signatures are at most 2 * edits apart in sum."""
    parts = [f"least(((({a} >> {6 * k}) & 63) - (({b} >> {6 * k}) & 63)) & 63, ((({b} >> {6 * k}) & 63) - (({a} >> {6 * k}) & 63)) & 63)" for k in range(len(LETTERS))]
    return f"{' + '.join(parts)} <= {2 * edits}"


def parities(line: Column) -> Column:
    """Which bits an odd number of the line's characters fall on (one, a long), and of its pairs of neighbours by their hash (low and high)."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("before"), *[zero.alias(k) for k in ("one", "low", "high")])
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    def step(x: Column, c: Column) -> Column:
        h = F.xxhash64(x["before"], c)
        first = h.bitwiseAND(F.lit(64)) == 0
        two = {"low": F.when(first, bit(h)).otherwise(zero), "high": F.when(first, zero).otherwise(bit(h))}
        return F.struct(c.alias("before"), *[x[k].bitwiseXOR(v).alias(k) for k, v in {"one": bit(F.ascii(c)), **two}.items()])

    return F.aggregate(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), start, step, lambda x: F.struct(x["one"], x["low"], x["high"]))


def near_parities(a: str, b: str, edits: int) -> str:
    """SQL: the parities of two lines, the second no shorter, differ in no more bits than edits can change.

    A replaced character changes two bits of one and four of low and high, one put in or taken out one and three; as
    many as the lengths differ by are put in.
    """
    bits = lambda *names: " + ".join(f"bit_count({a}.par.{x} ^ {b}.par.{x})" for x in names)
    return f"{bits('one')} <= {2 * edits} - ({b}.n - {a}.n) and {bits('low', 'high')} <= {4 * edits} - ({b}.n - {a}.n)"


def windows(edits: int) -> list[list[list[tuple[int, int]]]]:
    """By segment number i and remainder n % (edits + 1): the pieces of a line to hash, its own segment first.

    (off, more): the piece starts at i * base + off and has base + more code points, base being n div (edits + 1). Of
    a line of that many code points the last `remainder` segments are one longer. The others are where segment i of a
    line d shorter can lie.
    """
    cut, out = edits + 1, []
    for i in range(cut):
        out.append([])
        for rest in range(cut):
            pieces = []
            for d in range(cut):
                base, longer = divmod(rest - d, cut)
                start, more = i * base + max(0, longer - (cut - i)), base + (longer >= cut - i)
                # The shift that d = 0 and no edit before the segment give comes first.
                shifts = range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)
                pieces += [(start + s, more) for s in sorted(shifts, key=lambda s: (d == 0 and s != 0, s))]
            out[-1].append(list(dict.fromkeys(pieces)))
    return out


def key_columns(line: Column, n: Column, edits: int) -> dict[str, Column]:
    """The keys of a line by name, first those of its own segments. A key is null where a line has fewer."""
    cut, keys = edits + 1, {}
    base, rest = F.expr(f"cast(n div {cut} as int)"), F.expr(f"n % {cut}")
    by_rest = lambda values: reduce(lambda c, x: c.when(rest == x[0], x[1]), enumerate(values[1:], 1), F.when(rest == 0, values[0]))
    for i, pieces in enumerate(windows(edits)):
        for j in range(max(map(len, pieces))):
            off, more = (by_rest([p[min(j, len(p) - 1)][x] for p in pieces]) for x in (0, 1))
            key = F.xxhash64(F.substring(line, base * i + off + 1, base + more), F.lit(i))
            some = [r for r, p in enumerate(pieces) if j < len(p)]
            keys[f"k{i}_{j}"] = key if len(some) == cut else F.when(rest.isin(some), key)
    return dict(sorted(keys.items(), key=lambda x: not x[0].endswith("_0")))


def within(a_chars: Column, b_chars: Column, edits: int) -> Column:
    """Whether two lines, as arrays of characters, are at most edits apart.

    Bit e * width + t of the state: the first j characters of b and the first j + t - edits of a can be e edits apart.
    """
    width = 2 * edits + 1
    assert width * (edits + 1) < 31, "the state has to fit in an int"
    full = (1 << width * (edits + 1)) - 1
    rep = sum(1 << width * e for e in range(edits + 1))
    low, high = full & ~rep, full & ~(rep << (width - 1))
    shifted = lambda x: F.shiftleft(F.shiftleft(x, 1).bitwiseAND(F.lit(low)), width).bitwiseAND(F.lit(full))

    def closed(x: Column) -> Column:
        out = x
        for _ in range(edits):
            out = x.bitwiseOR(shifted(out))
        return out

    def step(x: Column, j: Column) -> Column:
        c = F.get(b_chars, j)
        match = F.lit(0)
        for t in range(width):
            match = match + F.when(F.get(a_chars, j + (t - edits)).eqNullSafe(c), 1 << t).otherwise(0)
        y = closed(x)
        moved = F.shiftleft(y.bitwiseOR(F.shiftright(y, 1).bitwiseAND(F.lit(high))), width).bitwiseAND(F.lit(full))
        return F.when(x == 0, x).otherwise(y.bitwiseAND(match * rep).bitwiseOR(moved))

    last = F.aggregate(F.sequence(F.lit(0), F.size(b_chars) - 1), F.lit(1 << edits), step)
    ends = sum(1 << width * e for e in range(edits + 1))
    return closed(last).bitwiseAND(F.call_function("shiftleft", F.lit(ends), F.size(a_chars) - F.size(b_chars) + edits)) != 0


def small_or_not(ids: DataFrame) -> DataFrame:
    """ids (stashed), to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def edit_links(docs: DataFrame, distinct: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """a, b: ids of all pairs of distinct lines at most edits apart, each once. distinct: id, h1, h2, place, n and keys."""
    keys = F.array(*[c for c in distinct.columns if c.startswith("k")])
    each = distinct.where(F.col("n") >= min_chars).select("id", "n", F.posexplode(keys).alias("at", "key")).where("key is not null")
    each = each.select("key", "id", "n", (F.col("at") <= edits).alias("own"))
    # Nearly all keys are of one line only: they are summed away before any line is looked at.
    shared = each.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("own").alias("own"))
    shared = stash(shared.where("low <> high and own").select("key"), "line-keys")
    hits = stash(each.join(small_or_not(shared), "key", "left_semi"), "line-hits")
    wanted = stash(distinct.join(hits.select("id").distinct(), "id", "left_semi").select("h1", "h2", "place", "id"), "line-ids")
    # By its first place a line is fetched once, however many copies it has; rows of one doc_id may bring it again.
    lines = lines_of(docs.select("doc_id", "text"), 1).select("h1", "h2", "place", "line")
    texts = stash(lines.join(small_or_not(wanted), ["h1", "h2", "place"]).select("id", "line").dropDuplicates(["id"]), "line-texts")
    signed = stash(hits.join(texts.select("id", signature(F.col("line"), F.length("line")).alias("sig"), parities(F.col("line")).alias("par")), "id"), "line-signed")
    met = signed.where("own").alias("i").join(signed.alias("p"), F.expr(f"i.key = p.key and p.n - i.n between 0 and {edits} and (p.n > i.n or i.id < p.id) and {near_signatures('i.sig', 'p.sig', edits)} and {near_parities('i', 'p', edits)}"))
    pairs = stash(met.select(F.col("i.id").alias("a"), F.col("p.id").alias("b")).distinct(), "line-pairs")
    left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    # Split into characters only here, and once: as fields of a struct that a lambda is given.
    both = F.array(F.struct(chars("line_a").alias("a"), chars("line_b").alias("b")))
    links = stash(pairs.join(left, "a").join(right, "b").where(F.exists(both, lambda x: within(x["a"], x["b"], edits))).select("a", "b"), "line-links")
    drop(shared, hits, wanted, texts, signed, pairs)
    return links


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """One row per line: the columns of docs but text, line_no, key (a hash of both line and line_no), class_place (place
    of the first line of its class), place, n_links (other distinct lines within the edits), kept.

    With short, lines under min_chars take part too: down to 2 * edits + 2 code points as longer ones do, below that
    with their exact copies only.
    """
    if short:
        min_chars = 2 * edits + 2
    assert min_chars > 2 * edits + 1, "segments would be too short"
    lines = lines_of(docs, 1 if short else min_chars)
    keys = key_columns(F.col("line"), F.col("n"), edits)
    marked = lines_of(docs.select("doc_id", "text"), 1 if short else min_chars).where("takes_part").select("h1", "h2", "place", "n", *[c.alias(name) for name, c in keys.items()])
    # All values but places are equal within a group; as minima of numbers they are summed in place, without a sort.
    own = marked.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in ("n", *keys)])
    distinct = stash(own.select(F.monotonically_increasing_id().alias("id"), "*"), "lines")
    links = edit_links(docs, distinct, edits, min_chars)
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "line-classes").withColumnRenamed("node", "id")
    linked = distinct.select("id", "h1", "h2", "place", "copies").join(found, "id").join(ends, "id")
    first = linked.groupBy("component").agg(F.min("place").alias("class_place"))
    linked = linked.join(first, "component").select("h1", "h2", "copies", "class_place", "n_links")
    alone = distinct.where("copies > 1").join(links.select(F.col("a").alias("id")).union(links.select("b")), "id", "left_anti").select("h1", "h2", "copies", F.col("place").alias("class_place"), F.lit(0).cast("long").alias("n_links"))
    # Only lines with a copy or a link can fall; the others are their own class.
    told = stash(linked.unionByName(alone), "line-verdicts")
    drop(distinct, links)
    out = spread(lines.withColumn("key", F.xxhash64("line", "line_no")).drop("line", "n"), told, ["h1", "h2"], "copies")
    own = F.coalesce(F.when(F.col("takes_part"), F.col("class_place")), F.col("place"))
    rest = [c for c in docs.columns if c != "text"]
    return out.select(*rest, "line_no", "key", "place", own.alias("class_place"), F.coalesce(F.when(F.col("takes_part"), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), (own == F.col("place")).alias("kept"))


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """docs with the lines that are not kept taken out of text; a document may be left empty, none is dropped."""
    # What falls is gathered by doc_id and text, so that rows without an id are not one group.
    gone = line_classes(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), edits, min_chars, short).where("not kept")
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("key").alias("_gone"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row = F.col("_row")
    both = own.join(gone, row["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(row["text"]) == F.col("_hash")), "left")
    kept = F.array_join(F.filter(F.split(row["text"], "\n"), lambda x, k: ~F.array_contains("_gone", F.xxhash64(x, k))), "\n")
    text = F.when(F.col("_gone").isNull(), row["text"]).otherwise(kept)
    return both.select(*[text.alias(c) if c == "text" else row.getField(c).alias(c) for c in docs.columns])


def op7_line_dedup(spark, sf_dir):
    """One row per line: its class by the place of the class's first line (a null doc_id stays null), its links, and whether it stays."""
    out = line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    doc, line = place_parts(F.col("class_place"))
    return out.select("doc_id", "line_no", doc.alias("class_doc_id"), line.alias("class_line_no"), "n_links", "kept")


#: Levenshtein of DuckDB counts bytes: it decides between ASCII lines. Others within 4 bytes an edit are told by rows of the edit table, made for two insertions at most.
OP7_SQL = r"""
with recursive docs as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
line as (select doc_id, unnest(range(len(ls)))::int as line_no, unnest(ls) as line from docs),
own as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as takes_part, {'none': doc_id is null, 'doc_id': coalesce(doc_id, 0), 'line_no': line_no} as place from line),
d as materialized (select line, length(line) as n, strlen(line) = length(line) as plain, min(place) as place, row_number() over () as id from own where takes_part group by line),
cand as materialized (select a.id as a, b.id as b, a.line as x, b.line as y, a.plain and b.plain as plain
  from d a join d b on b.n between a.n and a.n + 2 and (b.n > a.n or a.id < b.id) and a.n >= 6 and case when a.plain and b.plain then levenshtein(a.line, b.line) <= 2 else levenshtein(a.line, b.line) <= 8 end),
told as (select a, b, plain or list_reduce(string_split(y, ''),
    lambda prev, c: list_transform([list_transform(range(1, length(x) + 2), lambda i: least(prev[i] + 1, case when i > 1 then prev[i - 1] + (substr(x, i - 1, 1) <> c)::bigint end))],
      lambda tmp: list_transform(range(1, length(x) + 2), lambda i: least(tmp[i], case when i > 1 then tmp[i - 1] + 1 end, case when i > 2 then tmp[i - 2] + 2 end)))[1],
    range(0, length(x) + 1))[length(x) + 1] <= 2 as near from cand),
link as materialized (select a, b from told where near union all select b, a from told where near),
reach(id, other) as (select distinct a, a from link union select reach.id, link.b from reach join link on link.a = reach.other),
class as (select reach.id, min(place) as class_place from reach join d on d.id = reach.other group by reach.id),
ends as (select a as id, count(*) as n_links from link group by a),
verdict as (select line, coalesce(class_place, place) as class_place, coalesce(n_links, 0) as n_links from d left join class using (id) left join ends using (id)),
out as (select own.doc_id, own.line_no, place, coalesce(v.class_place, place) as c, coalesce(v.n_links, 0)::bigint as n_links from own left join verdict v on takes_part and own.line = v.line)
select doc_id, line_no, case when not c.none then c.doc_id end as class_doc_id, c.line_no as class_line_no, n_links, c = place as kept from out
"""
