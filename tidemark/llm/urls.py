"""URL rules with redirect equivalence: block decisions reach aliases over redirect and canonical-link edges.

A rule is (verdict, host, path); it fits its host and all subdomains if the url's path starts with the rule's, and the
longest fitting rule decides a url. Pages name other urls as the same document by <link rel="canonical"> and
<meta http-equiv="refresh">. Such urls, whether they are pages or not, form components; a url without a rule of its
own is blocked if some url of its component is blocked by rule. A url that a rule allows stays allowed, whatever its
aliases are, but lends that to none of them: else a blocked site could clear itself by naming an allowed page.

Urls are compared without scheme and fragment, host in lower case, dot segments of paths removed. Targets are read
with their entities decoded and seen from the page's <base href>, if it has one; those of other schemes than with
`://` name nothing. Cases: null urls and urls without `://` have empty
host and path, no rule and no edges, and are allowed; null html has no edges; repeated rows are judged each; edges
from a page to itself or given twice change nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import decode_entities
from tidemark.llm._common import components, drop, spread, stash, table
from tidemark.plans.sql import Chain, decode

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bound(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it: the optimizer does not unfold lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path (null: null) with its segments . and .. taken in."""
    add = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    taken = lambda p: F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), add), "/")
    return bound(path, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(taken(p), F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(p))


def address(url: Column) -> Column:
    """What two urls of one document share: host, path and query; null for no url."""
    query = lambda u: F.regexp_extract(u, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    path = lambda u: bound(path_of(u), lambda p: F.when(p == "", "/").otherwise(without_dots(p)))
    return bound(url, lambda u: F.when(u.contains("://"), F.concat(host_of(u), path(u), query(u))))


def rule_columns(host: Column, path: Column, rules: list) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def targets(html: Column) -> Column:
    """The addresses, as written, that a page gives as its own: canonical links and refreshes."""
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\s[^>]*>"), F.lit(0))
    links = F.transform(F.filter(tags("link"), lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?\s*canonical\b")), lambda t: F.regexp_extract(t, r"(?is)\shref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    moves = F.transform(F.filter(tags("meta"), lambda t: t.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?\s*refresh\b")), lambda t: F.regexp_extract(t, r"(?is)[;\s]url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    return F.filter(F.concat(F.coalesce(links, F.array().cast("array<string>")), F.coalesce(moves, F.array().cast("array<string>"))), lambda x: x != "")


def resolved(url: Column, target: Column) -> Column:
    """A target as a whole url, seen from url; null if it names no other document."""

    def of(x: Column) -> Column:
        u, t = x["u"], x["t"]
        scheme, path = F.regexp_extract(u, r"(?s)^(.*?)://", 1), path_of(u)
        root = F.concat(scheme, F.lit("://"), host_of(u))
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("/"), F.concat(root, t))
            .when(t.startswith("?"), F.concat(root, path, t))
            .when(~t.startswith("#") & (t != ""), F.concat(root, F.regexp_extract(F.concat(F.lit("/"), path), r"(?s)^/?(/.*/|/)", 1), t))
        )

    return bound(F.named_struct(F.lit("u"), url, F.lit("t"), target), of)


def base_of(url: Column, html: Column) -> Column:
    """The url that a page's targets are seen from."""
    given = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<base\s[^>]*?\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    return bound(given, lambda g: F.when(g != "", F.coalesce(resolved(url, decode_entities(g)), url)).otherwise(url))


def url_filter(pages: DataFrame, rules: list = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_verdict (what the component says where no rule does)."""
    one = pages.withColumn("targets", targets(F.col("html"))).where(F.size("targets") > 0)
    one = one.select("url", base_of(F.col("url"), F.col("html")).alias("base"), F.explode("targets").alias("target"))
    target = bound(F.col("target"), decode_entities)
    edges = one.select(address(F.col("url")).alias("a"), address(resolved(F.col("base"), target)).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = stash(edges, "url-edges")
    both = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("address")).agg(F.count(F.lit(1)).alias("copies"))
    nodes = stash(both.select(F.monotonically_increasing_id().alias("node"), "address", "copies"), "url-nodes")
    told = lambda address, node: nodes.select(F.col("address").alias(address), F.col("node").alias(node), "copies")
    numbered = spread(spread(edges, told("a", "u"), ["a"], "copies"), told("b", "v"), ["b"], "copies")
    found = components(numbered.select("u", "v"), "urls")
    whole = F.concat(F.lit("x://"), F.col("address"))
    known = nodes.select("node", "address").join(found, "node").withColumn("own", rule_columns(host_of(whole), path_of(whole), rules)[1])
    known = stash(known, "url-known")
    says = stash(known.groupBy("component").agg(F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"), F.count(F.lit(1)).alias("copies")), "url-components")
    aliases = spread(known.where("own is null"), says, ["component"], "copies").where("blocked").select("address")
    base = pages.select("page_id", address(F.col("url")).alias("address"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # How many pages have an alias's address, so that one of very many pages is told by broadcast.
    aliases = base.select("address").join(aliases, "address", "left_semi").groupBy("address").agg(F.count(F.lit(1)).alias("copies"))
    aliases = stash(aliases.withColumn("alias_verdict", F.lit("block")), "url-aliases")
    drop(edges, nodes, known, says)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    # Pages without an address have none's, each another one.
    out = spread(base.withColumn("address", F.coalesce("address", F.concat(F.lit(" "), F.xxhash64("page_id").cast("string")))), aliases, ["address"], "copies")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("alias_verdict"), F.lit("allow")).alias("verdict"), "alias_verdict")


def op9_redirect_equivalence(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _op9_sql() -> str:
    """The judgement in DuckDB SQL: addresses by RE2, blocked aliases by a recursion over the edges."""
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    take = "list_reduce(string_split(p, '/'), lambda d, x: case x when '.' then d when '..' then d[1:greatest(len(d) - 1, 1)] else list_append(d, x) end, []::varchar[])"
    clean = f"case when regexp_matches(p, '/\\.\\.?(/|$)') then array_to_string({take}, '/') || case when regexp_matches(p, '/\\.\\.?$') then '/' else '' end when p = '' then '/' else p end"
    address = lambda u: f"case when contains({u}, '://') then {host(u)} || list_transform([{path(u)}], lambda p: {clean})[1] || regexp_extract({u}, '(?s)^.*?://[^?#]*(\\?[^#]*)?', 1) end"
    scheme = lambda u: f"regexp_extract({u}, '(?s)^(.*?)://', 1)"
    seen = lambda u, t: f"""case when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {t} when regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
      when {t} like '//%' then {scheme(u)} || ':' || {t} when {t} like '/%' then {scheme(u)} || '://' || {host(u)} || {t} when {t} like '?%' then {scheme(u)} || '://' || {host(u)} || {path(u)} || {t}
      when {t} <> '' and {t} not like '#%' then {scheme(u)} || '://' || {host(u)} || regexp_extract('/' || {path(u)}, '(?s)^/?(/.*/|/)', 1) || {t} end"""  # noqa: E731
    space, value = "[\\t-\\r ]", "[\"'']?[\\t-\\r ]*([^\"''\\t-\\r >]+)"
    named = lambda tag, has, value_of: f"list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<{tag}{space}[^>]*>'), lambda x: regexp_matches(x, '(?is){space}{has}')), lambda x: regexp_extract(x, '(?is){value_of}', 1))"
    links = named("link", f"rel{space}*={space}*[\"'']?{space}*canonical\\b", f"{space}href{space}*={space}*{value}")
    moves = named("meta", f"http-equiv{space}*={space}*[\"'']?{space}*refresh\\b", f"[;\\t-\\r ]url{space}*={space}*{value}")
    base = f"regexp_extract(coalesce(html, ''), '(?is)<base{space}[^>]*?\\bhref{space}*={space}*{value}', 1)"
    named_urls = Chain(f"select url, {base} as base, unnest(list_concat({links}, {moves})) as target from pages", "url base target")
    decode(decode(named_urls, "base"), "target")
    named_urls.set(seen_from=f"coalesce({seen('url', 'base')}, url)")
    edges = named_urls.done(f"distinct {address('url')} as a, {address(seen('seen_from', 'target'))} as b").replace("with ", "", 1).replace("\nselect ", ",\ne as (select ", 1) + " where target <> '')"
    own = lambda h, p, what: f"(select {what} from rules where ({h} = h or ends_with({h}, '.' || h)) and starts_with({p}, p) order by length(h || p) desc limit 1)"
    return f"""
with recursive rules(v, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
{edges},
link as (select a, b from e where a <> b union select b, a from e where a <> b),
node as (select address, {host("'x://' || address")} as h0, {path("'x://' || address")} as p0 from (select distinct a as address from link)),
known as (select address, {own('h0', 'p0', 'v')} as own from node),
reached(address) as (select address from known where own = 'block' union select b from reached join link on a = address),
page as (select page_id, {address('url')} as address, {host('url')} as host, {path('url')} as path from pages),
alias as (select address, 'block' as alias_verdict from reached join known using (address) where own is null),
judged as (select *, {own('host', 'path', 'h || p')} as rule, {own('host', 'path', 'v')} as said from page)
select page_id, host, path, rule, coalesce(said, alias_verdict, 'allow') as verdict, alias_verdict from judged left join alias using (address)
"""


OP9_SQL = _op9_sql()
