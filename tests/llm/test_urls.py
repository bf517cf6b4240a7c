import random

import duckdb

from tests.compare import difference
from tidemark.llm import urls

RULES = {"com/en/": ("com", "/en/", "block"), "example.com/en/7": ("example.com", "/en/7", "allow"), "net/de/": ("net", "/de/", "allow"), "example.net/de/8": ("example.net", "/de/8", "block"), "org/es/": ("org", "/es/", "block")}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule(url):
    host, path = parts(url)
    fit = [name for name, (h, p, _) in RULES.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=len, default=None)


def page(*targets, kind="canonical"):
    tag = '<link href="{}" rel="canonical"/>' if kind == "canonical" else '<META http-equiv=refresh content="0; URL={}">'
    return "<html><head>" + "".join(tag.format(t) for t in targets) + "</head></html>"


PAGES = [
    (1, "https://a.example.com/en/9", page()),  # blocked by rule
    (2, "https://alias.test/x", page("http://a.example.com/en/9#top")),  # alias of 1
    (3, "http://alias.test/y?q=1", page("/x", kind="refresh")),  # alias of 2
    (4, "https://www.example.com/en/77", page("https://alias.test/x2")),  # allowed by rule
    (5, "https://alias.test/x2", page("https://b.com/en/1")),  # names a blocked one; that an allowed one names it does not help
    (6, "https://x.de.net/de/1", page("https://a.example.com/en/9")),  # its own rule stays
    (7, "https://free.test/", page("https://free.test/")),
    (8, None, page("https://a.example.com/en/9")),
    (9, "no scheme", None),
    (10, "HTTPS://EXAMPLE.NET/de/8", None),
    (11, "https://notexample.net/de/8", ""),
    (12, "https://alias.test/dir/z", page("../x", "z2", kind="refresh")),
    (12, "https://alias.test/dir/z", page("../x", "z2", kind="refresh")),
    (13, "https://alias.test/dir/z2", "<link rel=stylesheet href=https://b.com/en/1>"),
    (14, "https://b.com?/en/", None),
    (None, "https://b.com/en/", None),
    (15, "https://only-a-target.test/p", page("https://never-a-page.org/es/1")),
]


def test_rules_and_aliases(spark):
    rows = urls.url_filter(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    assert len(rows) == len(PAGES)
    known = {i: u for i, u, _ in PAGES}
    for r in rows:
        assert (r["host"], r["path"]) == parts(known[r["page_id"]]) and r["rule"] == rule(known[r["page_id"]])
        if r["rule"]:
            assert r["verdict"] == RULES[r["rule"]][2]
    verdict = {r["page_id"]: r["verdict"] for r in rows}
    assert {i: verdict[i] for i in (2, 3, 5, 7, 8, 9, 11, 12, 13, 14, 15)} == {2: "block", 3: "block", 5: "block", 7: "allow", 8: "allow", 9: "allow", 11: "allow", 12: "block", 13: "block", 14: "allow", 15: "block"}


def test_empty(spark):
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_chains_of_redirects(spark):
    n = 120
    chain = [(k, f"https://c{k}.test/", page(f"https://c{k + 1}.test/")) for k in range(n)] + [(n, f"https://c{n}.test/", page("https://b.com/en/1"))]
    rows = urls.url_filter(spark.createDataFrame(chain, "page_id long, url string, html string")).collect()
    assert {r["verdict"] for r in rows} == {"block"}


def test_entities_in_targets(spark):
    pages = [(1, "https://b.com/en/x?a=1&b=2", None), (2, "https://alias.test/y?a=1&b=2", None), (3, "https://alias.test/z", page("https://b.com/en/x?a=1&amp;b=2", "https://alias.test/y?a=1&amp;b=2"))]
    rows = urls.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {1: "block", 2: "block", 3: "block"}


def test_dots_bases_and_schemes(spark):
    pages = [
        (1, "https://b.com/en/x", None),
        (2, "https://c.test/a/b/c", page("../../x/./y/..")),  # names c.test/x/
        (3, "https://c.test/x/", page("https://b.com/q/../en/x")),
        (4, "https://d.test/", '<base target=_self href="//b.com/en/">' + page("x")),
        (5, "http://e.test/", page("mailto:a@b.com/en/x", "javascript:void(0)", "#x", "")),
        (6, "https://c.test/a/../x/?q", page("/x/")),
        (7, "https://f.test", page("..")),
    ]
    rows = urls.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow"}


def test_propagation_matches_brute_force(spark):
    import random

    r = random.Random(4)
    hosts = [f"h{k}.{r.choice(['com', 'net', 'org', 'test'])}" for k in range(60)]
    names = [f"https://{h}{r.choice(['/en/1', '/de/2', '/es/3', '/', '/x'])}" for h in hosts]
    pages = [(k, r.choice(names), page(*r.sample(names, r.choice([0, 0, 1, 1, 2])))) for k in range(90)]
    label = {n: n for n in names}
    links = [(u, t) for _, u, h in pages for t in names if f'"{t}"' in h]
    for _ in names:
        for u, t in links:
            label[u] = label[t] = min(label[u], label[t])
    own = lambda u: RULES[rule(u)][2] if rule(u) else None
    blocked = {label[n] for n in {u for e in links for u in e} if own(n) == "block"}
    want = {k: own(u) or ("block" if label[u] in blocked else "allow") for k, u, _ in pages}
    rows = urls.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == want and len(set(want.values())) == 2


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for c in ("targets", "address", "node", "copies", "verdict", "base"):
        frame = frame.withColumn(c, F.lit("own"))
    assert urls.url_filter(frame).count() == len(PAGES)


def test_sql_judges_alike(spark, tmp_path):
    """On links of every kind: odd pages, chains, entities, bases, and a random graph."""
    r = random.Random(5)
    hosts = ["a.com", "b.net", "x.example.com", "org", "alias.test", "Two.Test"]
    named = lambda k: r.choice(["", "http://", "//", "/"]) + r.choice(hosts) + f"/{r.choice(['en', 'de', 'es', 'q', '.', '..'])}/{k}" + r.choice(["", "?a=1&amp;b=2", "#f"])
    rows = [*PAGES] + [(k, f"https://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'q'])}/{r.randrange(40)}", page(*(named(r.randrange(40)) for _ in range(r.randrange(3))), kind=r.choice(["canonical", "refresh"]))) for k in range(100, 400)]
    rows += [(500, "https://c.test/a/b", '<base target=x href="/en/../q/"><link rel="canonical" href="7">'), (501, "https://b.com/en/0", page("mailto:x@y.test", "?k=1", "#top"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert difference(spark, duck_of(tmp_path), str(tmp_path), urls.op9_redirect_equivalence, urls.OP9_SQL) == ""


def duck_of(folder):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return con
