import hashlib
import re

from tests.llm.helpers import empty_docs, odd_docs, text
from tidemark.llm import pii


def slow(t):
    t, out = t or "", []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = [int(c) for c in m[0] if c.isdigit()]
            odd = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 13 <= len(digits) <= 19 and odd % 10 == 0 or k == 3 and 9 <= len(digits) <= 15:
                out.append((k, *m.span()))
    return out


TEXTS = [
    "mail a.b+c@x-y.example.org, and d@e.f.g.", "at 1.2.3.4 or 1.2.3.4.5 or 256.1.1.1 or 010.0.0.255 end", "pay 4111 1111 1111 1111 or 4111-1111-1111-1112 or 4111111111111111",
    "call +1 (555) 555-0199 now, +12 3, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "漢字\U0001f600 x@y.zz 1.1.1.1", None, "", "@@ a@b c@d.", "1" * 3000, "+" * 50 + "9" * 30,
]


def test_base_spans():
    for t in TEXTS:
        assert pii.base_spans(t or "") == slow(t)


def test_query_shape(spark):
    rows = pii.pii_spans(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    for r in rows:
        want = slow(TEXTS[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == n for s in want) for n in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"] == joined


def known_cards(n):
    """Numbers that pass the check, made by the last digit."""
    out = []
    for k in range(n):
        head = f"4{k:014d}"
        out.append(next(head + str(d) for d in range(10) if pii.luhn(head + str(d))))
    return out


def test_patterns_find_unseen_identifiers(spark):
    docs = [(k, f"{text(k, 6)} card number {c} {text(k + 50, 5)}") for k, c in enumerate(known_cards(12))]
    docs += [(50, "quiet river. Card Number 9999-ABCD-12345, and more"), (51, "the page number 99999 is not one"), (52, "card number none given 12345")]
    rows = {r["doc_id"]: r["spans"] for r in pii.pii_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    t = docs[12][1]
    a = t.index("9999-")
    assert rows[50] == f"card:{a}:{a + 15}" and rows[51] == "" and rows[52] == ""
    assert all(rows[k].startswith("card:") and "," not in rows[k] for k in range(12))


def test_weak_patterns_add_nothing(spark):
    docs = [(k, f"reach me {'a%d@b.cc' % k if k < 4 else 'no%d-thing%d' % (k, k)} today") for k in range(12)]
    rows = {r["doc_id"]: r["spans"] for r in pii.pii_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rows[k] == "" for k in range(4, 12))


def test_odd_cases(spark):
    docs = odd_docs(spark)
    rows = pii.pii_spans(docs).collect()
    assert len(rows) == docs.count() and all(r["n_card"] == 0 for r in rows)
    assert pii.pii_spans(empty_docs(spark)).count() == 0


def test_identifiers_with_spaces_and_without_digits(spark):
    cards = known_cards(12)
    docs = [(k, f"{text(k, 6)} card number {c} then write to a{'bcdefghijklm'[k]}@x.org now") for k, c in enumerate(cards)]
    more = ["4111 1111 1111 1112", "(030) 12 34 56", "555 123 4567"]
    docs += [(50 + k, f"the card number {x}, as said") for k, x in enumerate(more)]
    marked = ["jane.doe(at)example", "user@localhost", "jane [at] example [dot] org"]
    docs += [(60 + k, f"please write to {x}, as said") for k, x in enumerate(marked)]
    rows = {r["doc_id"]: r["spans"] for r in pii.pii_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    by = dict(docs)
    for first, kind, found in ((50, "card", more), (60, "email", marked)):
        for k, x in enumerate(found):
            a = by[first + k].index(x)
            assert rows[first + k] == f"{kind}:{a}:{a + len(x)}"


def test_found_identifiers_give_other_patterns_support(spark):
    docs = [(k, f"{text(k, 6)} card number {c} {text(k + 50, 5)}") for k, c in enumerate(known_cards(30))]
    docs += [(50 + k, f"card number 9999-ABCD-{k} and") for k in range(4)]
    docs += [(60 + k, f"billed under 9999-ABCD-{k} and") for k in range(4)]
    docs += [(70, "billed under 7777-WXYZ-1 and")]
    rows = {r["doc_id"]: r["spans"] for r in pii.pii_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[70] == "card:13:24" and rows[60] == "card:13:24"


def test_context_has_no_limit():
    assert pii.context("a " + "b" * 500 + " " * 300 + "12345", 802) == "a " + "b" * 500
    assert pii.context("only 12345", 5) is None


def test_long_runs_take_linear_time():
    import time

    for c in ("a", "1", "a.", "1.", "1 ", "+", "(at)", "@", "a@", "1.1.1.", "a(at)"):
        t = c * (400_000 // len(c))
        began = time.time()
        spans = pii.base_spans(t)
        assert sum(1 for _ in pii.mentions(t, spans)) >= 0 and time.time() - began < 20, c


def test_emails_match_the_pattern():
    import random

    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("ab@.@ -_1é") for _ in range(r.randint(0, 30)))
        assert list(pii.emails(t)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)], t
        t = "".join(r.choice("12.. 3é") for _ in range(r.randint(0, 30)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)], t


def test_secrets_are_found_by_their_context_alone(spark):
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(40)]
    docs = [(k, f'{text(k, 5)} token = "{x}" {text(k + 50, 4)}') for k, x in enumerate(hexes[:20])]
    docs += [(30, f'SHOUTS!! TOKEN = "{hexes[30].upper()}"!! LOUD'), (31, f"the commit {hexes[31]} of the river"), (32, 'token = "none"')]
    rows = {r["doc_id"]: r for r in pii.pii_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rows[k]["spans"].startswith("secret:") and rows[k]["n_added"] == rows[k]["n_spans"] == 1 for k in range(20))
    assert rows[30]["spans"] == "secret:18:58" and rows[31]["spans"] == rows[32]["spans"] == ""


def rounds(texts, threshold, smoothing, min_support):
    """The same graph, scored in plain Python: by text, the set of added (kind, start, end)."""
    all_ = [(d, *m) for d, t in enumerate(texts) for m in pii.mentions(t, pii.base_spans(t))]
    known = {}
    while True:
        label = lambda m: m[1] if m[1] >= 0 else known.get(m[4], -1)
        by, own = {}, {}
        for m in all_:
            for p in m[6]:
                by.setdefault(p, []).append((label(m), m[4]))
                own[p, m[4], m[1]] = own.get((p, m[4], m[1]), 0) + 1
        best, added = {}, {}
        for m in all_:
            if 0 <= m[1] <= 3:
                continue
            for p in m[6]:
                size = len(by[p]) - (own[p, m[4], m[1]] if m[1] < 0 else 0)
                for k in range(5):
                    hits = [x for y, x in by[p] if y == k]
                    score = len(hits) / (max(size, len(hits)) + smoothing)
                    if m[5] >> k & 1 and len(set(hits)) >= min_support and score >= threshold:
                        best[m[4]] = max(best.get(m[4], (0, 0)), (score, -k))
                        added[m[0], m[2], m[3]] = max(added.get((m[0], m[2], m[3]), (0, 0)), (score, -k))
        now = {i: -k for i, (_, k) in best.items()}
        if now == known:
            return {(d, -k, a, b) for (d, a, b), (_, k) in added.items()}
        known = now


def test_graph_matches_brute_force(spark):
    import random

    r = random.Random(9)
    cards, before = known_cards(40), ["card number", "billed under", "see the", "paid with card"]
    texts = []
    for k in range(160):
        kind = r.randrange(4)
        x = [r.choice([r.choice(cards), f"9999-{r.choice('ABC')}-{r.randint(1, 6)}1234"]), f"a{k}@b.cc", f"id{r.randint(1, 9)}", r.choice(["jane(at)home", f"1.2.3.{k}"])][kind]
        texts.append(f"{text(k, 2)} {before[kind] if r.random() < 0.9 else r.choice(before)} {x} {r.choice(['and so on', 'today', '. End'])}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = rounds(texts, 0.5, 1.0, 3)
    assert len(want) > 5
    for row in pii.pii_spans(docs, 0.5, 1.0, 3).collect():
        base = {(k, a, b) for k, a, b in pii.base_spans(texts[row["doc_id"]])}
        got = {(pii.ALL_KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in row["spans"].split(",") if x)}
        assert got - base == {x[1:] for x in want if x[0] == row["doc_id"]} and base <= got
