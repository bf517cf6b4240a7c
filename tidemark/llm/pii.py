"""Personal data: fixed patterns first, then bootstrapped contextual extraction.

Spans found by the fixed patterns are seeds of their kinds; long hexadecimal tokens are seeds of one more kind,
`secret`, which has no fixed pattern of its own: what it returns comes from the method alone. The text around a seed
gives lexical patterns, in lower case: the two and the three words before it, the two after it, the words on both
sides, and the word before with the token's shape. All identifier-like tokens of the corpus (with a digit, an at sign,
a dot inside or a mark like (at), not part of a base span) and runs of digit groups joined by spaces, brackets or
hyphens are instances of the patterns they stand in.

Spark scores this graph in rounds. A pattern's score for a kind is the share of its mentions whose instance is known
to be of that kind, smoothed, without the mentions of the instance that is judged; it needs min_support different
known ones. An unknown instance at a pattern that reaches the threshold becomes known, if it could be of the kind at
all (COULD), and so gives other patterns support in the next round; only what is known counts, so doubtful instances
do not talk each other up. Scores never fall, so the rounds end when nothing new is found. Then the mentions of the
instances at the patterns that carried them are added.

Cases: null and empty texts have no spans; repeated rows get the same spans each; overlapping finds of different kinds
all stay; a token that overlaps a base span is never added; ties between kinds go to the first kind; an empty table
gives an empty result; only doc_id and text are read. Context has no limit; instances and patterns over LONG code
points go by a hash of 128 bits. Time is linear in the length of a text.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import drop, stash, table

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: From the start of a run of digits only: no later start in the run could match where this one fails.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
SPACE = re.compile(r"[\x09-\x0D]")
#: Digit groups joined by spaces, brackets or hyphens, from the start of a token to the end of one.
RUN = re.compile(r"(?<![^\x20])[+(\[]*[0-9]++(?:[\x20()\[\]-]{1,3}[0-9]++)+(?=[^\w\x20]*(?:\x20|\Z))")
#: Names joined by marks like (at) and [dot].
MARKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[{<](?:at|dot|@|\.)[)\]}>]\x20?[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*)+", re.I)
#: What makes a token identifier-like: a digit, an at sign, a dot inside or a mark like (at).
SIGN = re.compile(r"[0-9]+|@|(?<=[^\W_])\.(?=[^\W_])|[(\[{<](?:at|dot)[)\]}>]", re.I)
#: Where a SIGN can be, found fast; and whether MARKED can match at all.
MAYBE = re.compile(r"[0-9@(\[{<]|\.(?=[^\W_])")
MARK = re.compile(r"[(\[{<](?:at|dot|@|\.)[)\]}>]", re.I)
SECRET = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}")
#: What a discovered instance must have to be of a kind: an at sign or mark; four groups of digits; five digits; letters and digits, 16 at least.
COULD = [
    lambda x: "@" in x or bool(re.search(r"[(\[{<]at[)\]}>]", x, re.I)),
    lambda x: len(DIGITS.findall(x)) >= 4,
    lambda x: sum(map(str.isdigit, x)) >= 5,
    lambda x: sum(map(str.isdigit, x)) >= 5,
    lambda x: len(x) >= 16 and x.isascii() and x.isalnum() and not x.isdigit() and not x.isalpha(),
]
LONG = 64
#: Rows in one batch, whatever the length of a text.
BATCH = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Spans of name@domain, the longest name before each at sign; looks out from the signs, so long words cost nothing."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at)):
            yield a, m.end()
            done = at = m.end()
        else:
            # What stands before this sign is no name for the next one.
            done = at = at + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start, of the fixed patterns."""
    out = [(0, *x) for x in emails(text)]
    if DIGITS.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in spans)


def short(x: str) -> str:
    return x if len(x) <= LONG else "#" + hashlib.blake2b(x.encode(errors="surrogatepass"), digest_size=16).hexdigest()


def words_before(t: str, at: int, n: int) -> list[str]:
    """The n words before a place of t (white space is plain spaces), the nearest first: runs of letters and digits, or of other signs."""
    out = []
    while len(out) < n:
        while at > 0 and t[at - 1] == " ":
            at -= 1
        if not at:
            break
        first, plain = at - 1, t[at - 1].isalnum()
        while first > 0 and t[first - 1] != " " and t[first - 1].isalnum() == plain:
            first -= 1
        out.append(t[first:at])
        at = first
    return out


def words_after(t: str, at: int, n: int) -> list[str]:
    out = []
    while len(out) < n:
        while at < len(t) and t[at] == " ":
            at += 1
        if at == len(t):
            break
        end, plain = at + 1, t[at].isalnum()
        while end < len(t) and t[end] != " " and t[end].isalnum() == plain:
            end += 1
        out.append(t[at:end])
        at = end
    return out


def context(text: str, start: int) -> str | None:
    """The two words before start in lower case, if there are two."""
    words = words_before(SPACE.sub(" ", text), start, 2)
    return f"{words[1]} {words[0]}".lower() if len(words) == 2 else None


def shape(x: str) -> str:
    """Mixed letters and digits by their number; else runs of digits by theirs, runs of letters as one."""
    if x.isalnum() and not x.isdigit() and not x.isalpha():
        return f"x{len(x)}"
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", x))


def patterns(t: str, a: int, b: int) -> list[str]:
    """The lexical patterns of a mention at a to b of t."""
    left, right = words_before(t, a, 3), words_after(t, b, 2)
    out = ["<" + " ".join(reversed(left[:n])) for n in (2, 3) if len(left) >= n]
    if len(right) == 2:
        out.append(">" + " ".join(right))
    if left:
        out.append(f"~{left[0]} {shape(t[a:b])}")
        if right:
            out.append(f"<{left[0]} > {right[0]}")
    return list(dict.fromkeys(short(x.lower()) for x in out))


def mentions(text: str, seeds: list[tuple[int, int, int]]):
    """(kind number or -1, start, end, instance, kinds it could be of as bits, patterns) of the seeds and of other identifier-like tokens and runs."""
    if not MAYBE.search(text):
        return
    t = SPACE.sub(" ", text)
    of = lambda k, a, b: (k, a, b, short(text[a:b]), sum(f(text[a:b]) << i for i, f in enumerate(COULD)), patterns(t, a, b))
    for k, a, b in seeds:
        yield of(k, a, b)
    starts, ends = [], []  # the seeds' spans, united
    for _, a, b in sorted(seeds, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        return a < b and not (k and ends[k - 1] > a)

    whole = [m.span() for m in RUN.finditer(t)] if DIGITS.search(t) else []
    whole = [x for x in sorted(whole + ([m.span() for m in MARKED.finditer(t)] if MARK.search(t) else [])) if free(*x)]
    k, at = 0, 0
    while maybe := MAYBE.search(t, at):
        m = SIGN.match(t, maybe.start())
        if not m:
            at = maybe.end()
            continue
        a, b = m.start(), m.end()
        while k < len(whole) and whole[k][1] <= a:
            k += 1
        if k < len(whole) and whole[k][0] < b:
            yield of(-1, *whole[k])
            at = max(at + 1, whole[k][1])
            continue
        a, b = t.rfind(" ", 0, a) + 1, t.find(" ", b)
        at = b = len(t) if b < 0 else b
        while b > a and not t[b - 1].isalnum():
            b -= 1
        while a < b and not (t[a].isalnum() or t[a] == "+"):
            a += 1
        if free(a, b):
            yield of(4 if SECRET.fullmatch(text, a, b) else -1, a, b)


def found(docs: DataFrame) -> DataFrame:
    """Rows of two sorts: one per row of docs with counts, base_sha256 and base spans, and one per mention (instance is not null)."""
    names = ("kind", "start", "end")
    counts = [f"n_{k}" for k in KINDS]
    schema = f"row long, doc_id long, {' long, '.join(counts)} long, base_sha256 string, base array<struct<kind:int,start:int,end:int>>, kind int, start int, end int, instance string, could int, patterns array<string>"
    span = pa.struct([(x, pa.int32()) for x in names])
    whole = pa.schema([(x, pa.int64()) for x in ("row", "doc_id", *counts)] + [("base_sha256", pa.string()), ("base", pa.list_(span))] + [(x, pa.int32()) for x in names] + [("instance", pa.string()), ("could", pa.int32()), ("patterns", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            rows = []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                spans = base_spans(text) if text else []
                n = {c: sum(s[0] == k for s in spans) for k, c in enumerate(counts)}
                rows.append({"row": row, "doc_id": doc, **n, "base_sha256": hashlib.sha256(joined(spans).encode()).hexdigest(), "base": [dict(zip(names, s)) for s in spans]})
                for m in mentions(text, spans) if text else ():
                    rows.append(dict(zip(("row", *names, "instance", "could", "patterns"), (row, *m))))
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, whole)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, whole)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def strong(graph: DataFrame, known: DataFrame | None, threshold: float, smoothing: float, min_support: int) -> DataFrame:
    """pattern, new (a kind), hits, size of the patterns that could reach the threshold for some instance.

    graph: pattern, instance, kind (-1: unknown), could, n. known: instance, new, of the instances found so far.
    """
    kind = F.col("kind")
    if known is not None:
        graph = graph.join(known, "instance", "left")
        kind = F.when(F.col("kind") < 0, F.coalesce("new", F.lit(-1))).otherwise(F.col("kind"))
    by_kind = graph.groupBy("pattern", kind.alias("label")).agg(F.sum("n").alias("hits"), F.count_distinct("instance").alias("support"))
    # At most one row for each kind and pattern from here on.
    each = F.collect_list(F.struct("label", "hits", "support"))
    scored = by_kind.groupBy("pattern").agg(F.sum("hits").alias("size"), each.alias("by")).select("pattern", "size", F.explode("by").alias("b"))
    scored = scored.where((F.col("b.label") >= 0) & (F.col("b.support") >= min_support)).select("pattern", F.col("b.label").alias("new"), F.col("b.hits").alias("hits"), "size")
    return scored.where(F.col("hits") >= threshold * (F.col("hits") + smoothing))


def accepted(graph: DataFrame, good: DataFrame, threshold: float, smoothing: float) -> DataFrame:
    """pattern, instance, score, new: unknown instances with the patterns that carry them, their own mentions not counted.

    A seed of the kind without a fixed pattern counts for its patterns, itself included.
    """
    size = F.col("size") - F.when(F.col("kind") < 0, F.col("n")).otherwise(0)
    met = graph.where("kind not between 0 and 3").join(good, "pattern").where("shiftright(could, new) & 1 = 1").withColumn("score", F.col("hits") / (F.greatest(size, F.col("hits")) + smoothing))
    return met.where(F.col("score") >= threshold).select("pattern", "instance", "score", "new")


def best(df: DataFrame, by: list[str]) -> DataFrame:
    """by, new: the kind of the best score, ties to the first kind."""
    return df.groupBy(*by).agg(F.max(F.struct("score", (-F.col("new")).alias("k"))).alias("x")).select(*by, (-F.col("x.k")).alias("new"))


def pii_spans(docs: DataFrame, threshold: float = 0.7, smoothing: float = 1.0, min_support: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the fixed patterns), spans (with the added ones), n_added, n_spans."""
    both = stash(found(docs), "pii")
    each = both.where("instance is not null").select("row", "kind", "start", "end", "instance", "could", F.explode("patterns").alias("pattern"))
    graph = stash(each.groupBy("pattern", "instance", "kind", "could").agg(F.count(F.lit(1)).alias("n")), "pii-graph")
    known, seen, now, passed = None, None, (0, None), None
    while now != seen:
        seen, old = now, [x for x in (known, passed) if x is not None]
        good = stash(strong(graph, known, threshold, smoothing, min_support), "pii-patterns")
        passed = stash(accepted(graph, good, threshold, smoothing), "pii-passed")
        known = stash(best(passed, ["instance"]), "pii-known")
        now = tuple(known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("instance", "new").cast("decimal(38,0)"))).first())
        drop(good, *old)
    drop(graph, known)
    added = best(each.where("kind not between 0 and 3").join(passed, ["pattern", "instance"]), ["row", "start", "end"])
    added = added.groupBy("row").agg(F.collect_list(F.struct(F.col("new").alias("kind"), "start", "end")).alias("added"))
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    names = F.array(*map(F.lit, ALL_KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = both.where("instance is null").select("row", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base").join(added, "row", "left")
    n = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"), n.alias("n_added"), (F.size("base") + n).cast("long").alias("n_spans"))


def op10_bootstrapped_pii(spark, sf_dir):
    """Patterns need ten different seeds here: three of a kind meet by chance in a large corpus."""
    return pii_spans(table(spark, sf_dir, "documents"), min_support=10)
