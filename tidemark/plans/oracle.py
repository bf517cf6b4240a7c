"""DuckDB SQL for the registered queries. Without one: what only a grouped map in order, or a whole build, can say."""

from __future__ import annotations

from tidemark.functions import rules
from tidemark.plans import samples as S
from tidemark.plans import sql as Q
from tidemark.plans.sql import Chain, has, q

SQL: dict[str, str] = {}
NOW = f"timestamp '{S.NOW}'"
DAY = f"'{S.NOW[:10]}'"
CATEGORIES = "[" + ", ".join("null::varchar[]" if c is None else "[" + ", ".join(map(q, c)) + "]::varchar[]" for c in S.CATEGORIES) + "]"

ITEMS = f"""(select d.doc_id as item_id, d.doc_id as item_ix, d.source as source_id, d.k as feed_ix, 'Feed ' || d.source as source_name, 'o' || (d.k % 14) as outlet,
  [{", ".join(map(q, S.LEANS))}][(d.k % 14) % 5 + 1] as lean, (d.k % 14) % 3 = 0 as wire, [{", ".join(map(q, S.HINTS))}][d.k % 6 + 1] as topic_hint,
  split_part(d.t, chr(10), 1) as title, substr(d.t, length(split_part(d.t, chr(10), 1)) + 2) as description, p.url as link,
  case when d.doc_id % 17 <> 0 then {NOW} - to_hours((d.doc_id % 72)::int) end as published, {CATEGORIES}[(d.doc_id % 7)::int + 1] as categories,
  coalesce(strftime(case when d.doc_id % 17 <> 0 then {NOW} - to_hours((d.doc_id % 72)::int) end, '%Y-%m-%d'), {DAY}) as edition
  from (select *, coalesce(text, '') as t, regexp_extract(source, '[0-9]+')::int as k from documents) d left join pages p on p.page_id = d.doc_id)"""
ITEM_COLS = "item_id item_ix source_id feed_ix source_name outlet lean wire topic_hint title description link published categories edition"
LITERALS = Q.values(list(enumerate(S.HEADLINES)), "id, text")
TEXTS = f"select 'literal' as kind, id::bigint as id, text from {LITERALS} union all select 'title', doc_id, split_part(text, chr(10), 1) from documents union all select 'document', doc_id, text from documents union all select 'page', page_id, html from pages"
URLS = f"select 'literal' as kind, id::bigint as id, url as x from {Q.values(list(enumerate(S.URLS)), 'id, url')} union all select 'page', page_id, url from pages"
MEMBERS = f"select * exclude (edition), {DAY} as edition, item_id % 97 as cluster_ix, item_id as member_ix from {ITEMS}"
MEMBER_COLS = ITEM_COLS + " cluster_ix member_ix"


def texts() -> Chain:
    return Chain(TEXTS.replace(", text from", ", text as x from", 1), "kind id x")


def members() -> Chain:
    return Chain(MEMBERS, MEMBER_COLS)


def unique(ch: Chain) -> Chain:
    return ch.over("select * from {s} qualify row_number() over (partition by cluster_ix, outlet order by member_ix) = 1", " ".join(ch.cols))


# --- text ---
SQL["decode_entities"] = Q.decode(texts(), "x").done("kind, id, x as value")
SQL["strip_html"] = Q.strip(texts(), "x").done("kind, id, x as value")
SQL["clean_description"] = Q.clean_description(texts(), "x").done("kind, id, x as value")
SQL["truncate_text"] = Q.truncate(texts(), "x", 80).done("kind, id, x as value")
SQL["first_sentences"] = Q.first_sentences(texts(), "x", 2, 260).done("kind, id, x as value")
SQL["without_quotes"] = texts().done(f"kind, id, {Q.without_quotes('x')} as value")
SQL["title_case"] = Q.title_case(Q.strip(texts(), "x"), "x", "value").done("kind, id, value")
SQL["tokenize"] = Q.strip(texts(), "x").done(f"kind, id, array_to_string({Q.tokens('x')}, ' ') as value")
SQL["entities"] = Q.entities(Q.strip(texts(), "x"), "x", "value").done("kind, id, array_to_string(value, '|') as value")
SQL["sensationalism"] = texts().done(f"kind, id, {Q.sensationalism('x')} as value")
SQL["opinion_score"] = Q.strip(texts(), "x").done(f"kind, id, {Q.opinion('x')}::int as value")
SQL["xml_escape"] = texts().done(f"kind, id, {Q.xml('x')} as value")
SQL["title_key"] = texts().done(f"kind, id, {Q.title_key('x')} as value")
SQL["soft_news"] = texts().done(f"kind, id, {Q.soft('x')} as value")
SQL["stem_words"] = f"select word, {Q.stems('[word]')}[1] as stem from (select distinct unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) as word from documents) where word <> ''"
SQL["stable_id"] = f"select item_id, {Q.stable_id('title', 'published')} as id from {ITEMS}"

# --- addresses, feeds, registry ---
SQL["clean_urls"] = Q.clean_url(Chain(URLS, "kind id x"), "x").done("kind, id, x as value")
SQL["url_paths"] = Chain(URLS, "kind id x").done(f"kind, id, {Q.url_path('x')} as value")
SQL["percent_encoded"] = Chain(URLS, "kind id x").done("kind, id, replace(replace(replace(replace(replace(replace(url_encode(x), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') as value")
SQL["parse_dates"] = "select id::bigint as id, said::timestamp as \"at\" from " + Q.values([(k, t) for k, t in enumerate(S.INSTANTS)], "id, said")
_fed = Q.strip(Chain(f"select * from {ITEMS}", ITEM_COLS).set(x="title"), "x")
_fed = Q.clean_url(_fed.set(url="coalesce(link, '')"), "url")
# An empty href is none, so the first link speaks.
_fed.set(url="case when url = '' and item_id % 2 = 1 then 'https://self.example.com/' else url end")
SQL["parse_feeds"] = _fed.done("item_id, 0 as item_ix, x as title, url as link, published, coalesce(array_to_string(list_filter(list_transform(categories, lambda c: trim(c)), lambda c: c <> ''), '|'), '') as categories") + " where x <> ''"
REGISTRY = f"(select distinct source_id as id, source_name as name, lean, wire, outlet, topic_hint as topic, feed_ix from {ITEMS})"
SQL["registry_balance"] = f"select coalesce(topic, 'general') as topic, count(*) as feeds, count(distinct coalesce(outlet, id)) as outlets, abs(count(*) filter (where lean in ('left', 'center-left')) - count(*) filter (where lean in ('right', 'center-right'))) as tilt from {REGISTRY} group by all"
SQL["registry_join"] = f"select i.item_id, i.source_id, coalesce(r.outlet, i.source_id) as outlet, coalesce(r.lean, 'center') as lean, coalesce(r.wire, false) as wire, r.topic as topic_hint, coalesce(r.name, i.source_id) as source_name from {ITEMS} i left join (select * from {REGISTRY} where feed_ix % 2 = 1) r on r.id = i.source_id"
SQL["probe_report"] = f"with log as (select source_id, lean, feed_ix % 7 <> 3 as ok, count(*) as items from {ITEMS} group by all) select lean, count(*) filter (where ok and items > 0) as working, count(*) as feeds, sum(case when ok and items > 0 then items else 0 end)::bigint as items from log group by lean"


# --- admission ---
def judged(base: str, cols: str) -> Chain:
    """Adds newsworthy, and x (the plain title)."""
    ch = Q.strip(Chain(base, cols).set(x="title"), "x")
    ch.set(_path=Q.url_path("link"))
    section = lambda names: f"coalesce(regexp_matches(_path, {q('(?i)/(?:' + '|'.join(names) + ')/')}), false)"
    category = f"len(list_filter(coalesce(categories, []), lambda c: regexp_matches({Q.trim('c')}, {q('(?i)^(?:' + '|'.join(rules.EXCLUDED_CATEGORIES) + ')$')}))) > 0"
    bad = " or ".join([section(rules.EXCLUDED_SECTIONS), section(rules.OPINION_SECTIONS), category, "length(x) < 15", *[has("title", p) for p in rules.EXCLUDED_TITLES], f"{Q.opinion('x')} >= {rules.OPINION_NEEDED}"])
    return ch.set(newsworthy=f"coalesce(title <> '' and not ({bad}), false)")


SQL["newsworthy"] = judged(f"select 'literal' as kind, id::bigint as id, text as title, 'https://example.org/a' as link, []::varchar[] as categories from {LITERALS} union all select 'item', item_id, title, link, categories from {ITEMS}", "kind id title link categories").done("kind, id, newsworthy")
SQL["age_filter"] = f"select item_id, published from {ITEMS} where published is null or published >= {NOW} - interval 36 hours"


def admitted(hours: str | None = "36", per_feed: int | None = 30) -> Chain:
    ch = judged(f"select * from {ITEMS}", ITEM_COLS)
    cols = " ".join(ch.cols)
    fresh = f"and (published is null or published >= {NOW} - interval {hours} hours)" if hours else ""
    ch.over("select * from {s} where coalesce(link, '') <> '' and newsworthy " + fresh, cols)
    ch.over(f"select * from {{s}} qualify row_number() over (partition by source_id, {Q.title_key('title')} order by item_ix) = 1", cols)
    if per_feed:
        ch.over(f"select * from {{s}} qualify row_number() over (partition by source_id order by item_ix) <= {per_feed}", cols)
    return ch.set(title="x")


SQL["feed_admission"] = admitted().done("item_id, source_id, title")
SQL["title_dedupe"] = admitted(None, None).done("item_id, source_id")


# --- vectors ---
def weights() -> Chain:
    ch = Q.strip(admitted().set(d="coalesce(description, '')"), "d")
    Q.strip(ch, "title")
    ch.set(tt=Q.tokens("title"), dt=f"({Q.tokens('d')})[1:40]")
    Q.entities(ch, "title", "te")
    Q.entities(ch, "d", "de").set(de="de[1:20]")
    ch.set(names="flatten(list_transform(list_concat(te, de), lambda e: " + Q.stems("string_split_regex(e, ' +')").replace("lambda w", "lambda w") + "))")
    part = lambda c, w, mark: f"list_transform({c}, lambda t: {{'term': '{mark}' || t, 'w': {w}e0}})"
    ch.set(terms=f"list_concat(list_concat({part('tt', 1, '')}, {part('te', 1.7, '@')}), list_concat({part('dt', 0.45, '')}, {part('de', 0.45 * 1.7, '@')}))")
    ch.over("select edition, item_id, names, unnest(terms) as e from {s}", "edition item_id names e")
    return ch.over("select edition, item_id, e.term as term, sum(e.w) as tf, bool_or(starts_with(e.term, '@') or list_contains(names, e.term)) as proper from {s} group by edition, item_id, e.term", "edition item_id term tf proper")


SQL["term_weights"] = weights().done("edition, item_id, term, round(tf, 6) as tf, proper")


def with_idf() -> Chain:
    ch = weights()
    return ch.over("select *, count(*) over (partition by edition, term) as df, (select count(distinct item_id) from {s} b where b.edition = a.edition) as n from {s} a", "edition item_id term tf proper df n").set(idf="ln((n + 1) / (df + 0.5e0))")


SQL["idf"] = with_idf().done("distinct edition, term, df, round(idf, 6) as idf")
SQL["unit_vectors"] = with_idf().done("edition, item_id, term, proper, round(tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by edition, item_id)), 6) as w")
_pairs = with_idf().over("select edition, item_id, term, proper, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by edition, item_id)) as w from {s}", "edition item_id term proper w")
_v = f"s{len(_pairs.steps) - 1}"
SQL["pair_evidence"] = _pairs.over(
    """select a.edition, a.item_id as a, b.item_id as b, sum(a.w * b.w) as cosine, count(distinct case when a.w * b.w >= 0.03e0 then regexp_replace(a.term, '^@', '') end) as shared,
  count(*) filter (where a.w * b.w >= 0.012e0 and not a.proper and not b.proper) as predicate from {s} a join {s} b on a.edition = b.edition and a.term = b.term and a.item_id < b.item_id group by all""",
    "edition a b cosine shared predicate",
).set(
    exclusive_a=f"coalesce((select max(v.w) from {_v} v where v.edition = s{len(_pairs.steps) - 1}.edition and v.item_id = a and v.proper and v.term not in (select u.term from {_v} u where u.item_id = b)), 0e0)",
    exclusive_b=f"coalesce((select max(v.w) from {_v} v where v.edition = s{len(_pairs.steps) - 1}.edition and v.item_id = b and v.proper and v.term not in (select u.term from {_v} u where u.item_id = a)), 0e0)",
).done("edition, a, b, round(cosine, 6) as cosine, round(exclusive_a, 6) as exclusive_a, round(exclusive_b, 6) as exclusive_b, round(least(exclusive_a, exclusive_b), 6) as contested, shared, predicate, case when cosine > 0 then round(least(exclusive_a, exclusive_b) / cosine, 3) end as ratio")

# --- scores ---
SQL["unique_outlets"] = unique(members()).done("cluster_ix, outlet, member_ix")
WEIGHT = "case lean " + " ".join(f"when {q(k)} then {v}" for k, v in rules.LEAN_WEIGHTS.items()) + " else 0 end"
SPREAD = f"case when count(*) >= 2 then (max({WEIGHT}) - min({WEIGHT})) / 4e0 else 0e0 end"
BAR = " || ".join(f"case when count(*) filter (where lean = {q(x)}) > 0 then '#' else '.' end" for x in rules.LEAN_WEIGHTS)
SQL["lean_spread"] = unique(members()).done(f"cluster_ix, round({SPREAD}, 6) as lean_spread, {BAR} as bar") + " group by cluster_ix"
SCORED = f"""with m as ({MEMBERS}),
u as (select * from m qualify row_number() over (partition by cluster_ix, outlet order by member_ix) = 1),
a as (select cluster_ix, count(*) as outlets_counted, count(distinct coalesce(lean, '?')) as leans, count(*) filter (where wire) as wires, {SPREAD} as lean_spread from u group by cluster_ix),
b as (select cluster_ix, max(published) as newest, count(*) as members, avg(case when {Q.soft('title')} then 1e0 else 0e0 end) as softness from m group by cluster_ix),
c as (select *, 3e0 * log2(1e0 + outlets_counted) as breadth, 1.4e0 * (leans - 1) + 2.2e0 * lean_spread as diversity, 0.8e0 * least(wires, 4) as wire,
  2.5e0 * pow(0.5e0, (case when newest is null then 24e0 else greatest(0e0, (epoch_us({NOW}) - epoch_us(newest)) / 3.6e9) end) / 18e0) as freshness, -6e0 * softness + 0e0 as soft_penalty from a join b using (cluster_ix))"""
TOTAL = "breadth + diversity + wire + freshness + soft_penalty"
SQL["score_components"] = SCORED + f" select cluster_ix, outlets_counted, leans, wires, newest, members, {', '.join(f'round({c}, 6) as {c}' for c in ('lean_spread', 'softness', 'breadth', 'diversity', 'wire', 'freshness', 'soft_penalty'))}, round({TOTAL}, 6) as total from c"
SQL["consensus_rank"] = SCORED + f", d as (select cluster_ix, outlets_counted, leans, round({TOTAL}, 6) as total from c) select *, (row_number() over (order by total desc, cluster_ix))::int as rank from d qualify rank <= 10"


def marked() -> Chain:
    """Unique members with tokens, core, representative, sensational, cost, is_headline."""
    ch = unique(members())
    Q.strip(ch.set(plain="title"), "plain").set(tok=Q.tokens("plain"))
    cols, s = " ".join(ch.cols), f"s{len(ch.steps) - 1}"
    ch.over(f"""select u.*, coalesce(k.core, []) as core from {{s}} u left join (select cluster_ix, list_sort(list(term)) as core from
      (select t.cluster_ix, t.term, count(*) as c, any_value(n.n) as n from (select cluster_ix, unnest(list_distinct(tok)) as term from {s}) t join (select cluster_ix, count(*) as n from {s} group by all) n using (cluster_ix) group by all)
      where c >= greatest(2, ceil(n * 0.4e0)) group by cluster_ix) k on k.cluster_ix = u.cluster_ix""", cols + " core")  # fmt: skip
    ch.set(representative="case when len(core) = 0 then 1e0 else len(list_intersect(list_distinct(tok), core)) / len(core)::double end", sensational=Q.sensationalism("title"))
    ch.set(cost="sensational - case when wire then 1.25e0 else 0e0 end - 5e0 * representative")
    return ch.set(is_headline="row_number() over (partition by cluster_ix order by cost, length(title), member_ix) = 1")


SQL["core_terms"] = marked().done("distinct cluster_ix, array_to_string(core, ' ') as core")
SQL["headline_costs"] = marked().done("cluster_ix, member_ix, round(representative, 6) as representative, sensational, round(cost, 6) as cost, is_headline")


def summaries() -> str:
    ch = marked().set(clean="description")
    Q.clean_description(ch, "clean")
    Q.strip(ch.set(pair="title || ' ' || clean"), "pair").set(pair=f"list_distinct({Q.tokens('pair')})")
    Q.strip(ch.set(judged="clean"), "judged")
    ch.set(head="max(case when is_headline then list_distinct(tok) end) over (partition by cluster_ix)")
    ch.set(about="case when len(core) > 0 then core else head end")
    ch.set(rep="case when len(about) = 0 then 1e0 else len(list_intersect(pair, about)) / len(about)::double end")
    ch.set(able="length(clean) >= 60 and (len(head) = 0 or len(list_intersect(pair, head)) / greatest(len(head), 1)::double >= 0.2e0)")
    ch.set(price=f"case when wire then -2e0 else 0e0 end + {Q.sensationalism('clean')} * 0.5e0 + {Q.opinion('judged')} * 1.5e0 + case when is_headline then 0.75e0 else 0e0 end - 5e0 * rep")
    ch.set(turn="row_number() over (partition by cluster_ix order by able desc, price, member_ix)", spare="row_number() over (partition by cluster_ix order by length(clean) >= 40 desc, is_headline desc, member_ix)")
    ch.over("select cluster_ix, max(case when turn = 1 and able and rep >= 0.2e0 then clean end) as best, max(case when turn = 1 and able and rep >= 0.2e0 then source_id end) as summary_source, max(case when spare = 1 and length(clean) >= 40 then clean end) as spare from {s} group by cluster_ix", "cluster_ix best summary_source spare")
    Q.first_sentences(ch.set(said="best"), "said", 2, 260)
    Q.truncate(ch, "spare", 260)
    return ch.done("cluster_ix, case when said <> '' then said else spare end as summary, summary_source")


SQL["summaries"] = summaries()
_cover = Q.truncate(unique(members()), "title", 180)
SQL["coverage_list"] = _cover.done("cluster_ix, (row_number() over (partition by cluster_ix order by source_name collate icu_noaccent, member_ix) - 1)::int as place, source_name as source, source_id as \"sourceId\", lean, title, link as url").replace(" collate icu_noaccent", "")


# --- topics ---
def hits(c: str, topic: str) -> str:
    return "(" + " + ".join(f"case when {has(c, p)} then 1 else 0 end" for p in rules.KEYWORDS[topic]) + ")"


def evidence() -> Chain:
    ch = Q.strip(Q.strip(members().set(x="title", y="description"), "x"), "y").set(said="x || ' ' || y", _path=Q.url_path("coalesce(link, '')"))
    for t in rules.SPECIALIST:
        section = lambda p: f"case when regexp_matches(_path, {q('(?i)' + p)}) then 2.5e0 else 0e0 end"
        prov = f"case when topic_hint in ({', '.join(q(h) for h, ts in rules.HINTS.items() if t in ts)}) then 4e0 else 0e0 end + {section(rules.TOPIC_SECTIONS[t])}"
        prov += f" + {section(rules.SCIENCE_SECTIONS)}" if t != "business" else ""
        prov += f" + case when len(list_filter(coalesce(categories, []), lambda c: regexp_matches({Q.trim('c')}, {q('(?i)^(?:' + '|'.join(rules.TOPIC_CATEGORIES[t]) + ')$')}))) > 0 then 2e0 else 0e0 end"
        ch.set(**{f"prov_{t}": prov, f"hits_{t}": hits("said", t)})
    return ch


SQL["topic_evidence"] = evidence().done("item_id, " + ", ".join(f"prov_{t}, hits_{t}, prov_{t} + least(hits_{t}, 4) as score_{t}" for t in rules.SPECIALIST))
SQL["topic_literals"] = Q.strip(Chain(f"select id::bigint as id, text as x from {LITERALS}", "id x"), "x").done("id, " + ", ".join(f"{hits('x', t)} as hits_{t}" for t in rules.SPECIALIST))


def votes() -> Chain:
    ch = evidence().over("select cluster_ix, coalesce(outlet, source_id, link, member_ix::varchar) as o, " + ", ".join(f"bool_or(prov_{t} > 0) as v_{t}, max(hits_{t}) as h_{t}" for t in rules.SPECIALIST) + " from {s} group by all", "cluster_ix o")
    names = ", ".join(f"count(*) filter (where v_{t}) as votes_{t}, sum(h_{t})::bigint as support_{t}" for t in rules.SPECIALIST)
    return ch.over(f"select cluster_ix, count(*) as outlets, count(*) filter (where {' or '.join(f'v_{t}' for t in rules.SPECIALIST)}) as specialists, {names} from {{s}} group by cluster_ix", "cluster_ix outlets specialists " + " ".join(f"votes_{t} support_{t}" for t in rules.SPECIALIST))


SQL["topic_votes"] = votes().done("*")


def classified() -> str:
    ch = votes()
    ch.over(f"select v.*, l.text as headline, l.text as x from {{s}} v left join {LITERALS} l on l.id = v.cluster_ix", " ".join(ch.cols) + " headline x")
    Q.strip(ch, "x")
    ch.set(**{f"r_{t}": f"case when votes_{t} > 0 then votes_{t} + least(support_{t}, 6) * 0.01e0 else 0e0 end" for t in rules.SPECIALIST}, **{f"k_{t}": hits("x", t) for t in rules.SPECIALIST}, share="specialists / outlets::double")
    ch.set(top=f"greatest({', '.join(f'r_{t}' for t in rules.SPECIALIST)})", **{f"o_{t}": f"case when votes_{t} > 0 then k_{t} else -1 end" for t in rules.SPECIALIST})
    ch.set(lead=f"greatest({', '.join(f'o_{t}' for t in rules.SPECIALIST)})")
    claim = "(specialists >= 2 or specialists = outlets) and (share >= 0.5e0 or (specialists >= 3 and share >= 0.34e0))"
    ch.set(coverage_topic=f"case when {claim} and top > 0 then case {' '.join(f'when r_{t} = top then {q(t)}' for t in rules.SPECIALIST)} end else 'world' end")
    own = "case coverage_topic " + " ".join(f"when '{t}' then k_{t}" for t in rules.SPECIALIST) + " else 0 end"
    alone = " + ".join(f"(o_{t} = lead)::int" for t in rules.SPECIALIST)
    ch.set(topic=f"case when coverage_topic = 'world' or coalesce(headline, '') = '' or {own} > 0 or lead <= 0 or {alone} > 1 then coverage_topic else case {' '.join(f'when o_{t} = lead then {q(t)}' for t in rules.SPECIALIST)} end end")
    return ch.done("cluster_ix, coverage_topic, topic, case when topic <> coverage_topic then coverage_topic || ' -> ' || topic || ' by headline' end as reconciled, floor(share * 100 + 0.5e0) / 100 as specialist_share")


SQL["classify_clusters"] = classified()
ORDERS = "(select strftime(o_orderdate, '%Y-%m') as edition, ['world', 'tech', 'business', 'health', 'world'][left(o_orderpriority, 1)::int] as topic, o_totalprice as total, o_custkey % 6 as outlets_counted, o_orderkey as cluster_ix from orders)"


def quota(limit: int, least: int) -> str:
    """The quota and backfill, by edition, as named subqueries ending in `chosen`."""
    order = "total desc, cluster_ix"
    topics = Q.values([(k, t, n) for k, (t, n) in enumerate(rules.QUOTAS.items())], "ord, topic, n")
    return f"""with r as (select *, row_number() over (partition by edition order by {order}) as gr from {ORDERS}),
e as (select r.*, t.ord, t.n, row_number() over (partition by edition, r.topic order by gr) as rn from r join {topics} t on t.topic = r.topic where r.topic = 'world' or outlets_counted >= {least}),
f as (select * from e where rn <= n qualify row_number() over (partition by edition order by ord, rn) <= {limit}),
g as (select r.* from r where (edition, cluster_ix) not in (select (edition, cluster_ix) from f)),
h as (select g.*, row_number() over (partition by g.edition order by gr) as k, coalesce(c.n, 0) as had from g left join (select edition, count(*) as n from f group by all) c on c.edition = g.edition),
chosen as (select edition, cluster_ix, topic, total from f union all select edition, cluster_ix, topic, total from h where k <= {limit} - had)"""


SQL["quota_select"] = quota(10, 3) + " select edition, (row_number() over (partition by edition order by total desc, cluster_ix))::int as rank, cluster_ix, topic, total from chosen"
SQL["quota_select_seven"] = quota(7, 5) + " select edition, (row_number() over (partition by edition order by total desc, cluster_ix))::int as rank, cluster_ix, topic, total from chosen"
SQL["missed_specialists"] = quota(7, 3) + f", m as (select * from {ORDERS} o where topic <> 'world' and (edition, cluster_ix) not in (select (edition, cluster_ix) from chosen)) select edition, (row_number() over (partition by edition order by outlets_counted desc, cluster_ix))::int as place, cluster_ix, topic, outlets_counted as outlets from m qualify place <= 6"

# --- publishing ---
STORIES = f"""(select edition, (item_id + 1)::int as rank, 's' || item_id as id, t as topic, upper(t[1]) || t[2:] as label, case when item_id % 5 <> 0 then upper(t) end as short, title,
  case when item_id % 3 <> 0 then description end as summary, link as url, source_name as head, (item_id % 5 + 1)::int as outlets, (item_id % 3 + 1)::int as leans, item_id % 4 <> 0 as covered, title as short_title, lean
  from (select *, ['world', 'tech', 'business', 'health'][(item_id % 4)::int + 1] as t from {ITEMS}))"""
SQL["topic_report"] = f"select edition, {', '.join(f'count(*) filter (where topic = {q(t)}) as {t}' for t in rules.TOPICS)}, count(distinct topic) as topics, count(distinct topic) = 1 as monoculture from {STORIES} group by edition"
x = Q.xml
plural = lambda n, w: f"{n}::varchar || ' {w}' || case when {n} = 1 then '' else 's' end"
some = lambda c: f"coalesce({c}, '') <> ''"
LISTED = f"""'<li>' || {x('head')} || ' <em>(' || {x('lean')} || ')</em> — ' || case when {some('url')} then '<a href="' || {x('url')} || '">' || {x('short_title')} || '</a>' else {x('short_title')} end || '</li>'"""
BODY = f"""case when {some('summary')} then '<p>' || {x('summary')} || '</p>' else '' end || '<p><strong>' || {plural('outlets', 'outlet')} || ' · ' || {plural('leans', 'editorial lean')} || ' · headline via ' || {x('head')} || '</strong></p>'
  || case when covered then chr(10) || '      <p>Also reported by:</p>' || chr(10) || '      <ul>' || chr(10) || '        ' || {LISTED} || chr(10) || '      </ul>' else '' end"""
SQL["atom_entries"] = f"""select edition, rank, '  <entry>' || chr(10) || '    <title>' || {x('title')} || '</title>' || chr(10)
  || '    <link rel="alternate" href="' || {x(f"case when {some('url')} then url else 'https://site.example.com/' end")} || '"/>' || chr(10) || '    <id>tag:tidemark,' || edition || ':' || {x('id')} || '</id>' || chr(10)
  || '    <updated>2024-01-30T00:00:00Z</updated>' || chr(10) || '    <category term="' || {x('topic')} || '" label="' || {x('label')} || '"/>' || chr(10) || '    <author><name>' || {x('head')} || '</name></author>' || chr(10)
  || '    <summary type="text">' || {x(f"case when {some('summary')} then summary else title end")} || '</summary>' || chr(10) || '    <content type="html">' || {x('b')} || '</content>' || chr(10) || '  </entry>' as entry
  from (select *, {BODY} as b from {STORIES})"""
LINE = f"rank::varchar || ' of 10 · ' || {plural('outlets', 'outlet')} || ' · ' || {plural('leans', 'lean')} || ' · via ' || head"
DELAY = "1706616000 + (rank - 1) * 45"
js = lambda c: f"to_json({c})::varchar"
SQL["push_messages"] = f"""select edition, rank, '{{"topic":"news","title":' || {js("case when " + some("short") + " then short || ' · ' || title else title end")} || ',"message":' || {js(f"case when {some('summary')} then summary || chr(10) || chr(10) || {LINE} else {LINE} end")}
  || ',"priority":3,"tags":["newspaper"]' || case when {some('url')} then ',"click":' || {js('url')} else '' end || ',"delay":"' || ({DELAY})::varchar || '"}}' as message from {STORIES}"""
enc = lambda c: "replace(replace(replace(replace(replace(replace(url_encode(" + c + "), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
_body = f"'**Edition** ' || edition || chr(10) || '**Rank** ' || rank::varchar || chr(10) || '**Topic** ' || topic || chr(10) || '**Headline** ' || title || chr(10) || case when {some('url')} then '**Link** ' || url else '' end || chr(10) || chr(10) || 'What is wrong with it:' || chr(10)"
_flag = f"'https://github.com/example/example/issues/new?labels=brief-report&title=' || {enc("left('Brief ' || edition || ' #' || rank::varchar || ': ' || title, 120)")} || '&body=' || {enc(_body)}"
SQL["flag_urls"] = f"select rank, case when length(f) <= 1800 then f end as flag from (select rank, {_flag} as f from {STORIES})"

# --- delivery ---
ZONE = "'America/Chicago'"
local = lambda t: f"timezone({ZONE}, timezone('UTC', {t}))"
slot_of = lambda day: f"timezone('UTC', timezone({ZONE}, {day}::timestamp + interval 6 hours))"
SQL["delivery_plans"] = f"""with a as (select event_id, ts, {local('ts')}::date as day from events), b as (select *, {slot_of('day')} as slot, {slot_of(f"({local('(ts + interval 1 day)')})::date")} as later from a),
c as (select *, floor((epoch_us(ts) - epoch_us(slot)) / 6e7 + 0.5e0)::bigint as late, ts > slot as passed from b),
d as (select *, case when not passed then 'schedule' when late <= 180 then 'now' else 'skip' end as action from c)
select event_id, day, action, case action when 'schedule' then case when slot < ts + interval 10 seconds then later else slot end when 'now' then ts + interval 1 minute end as deliver_at, case when passed then late else 0 end as late_minutes, slot from d"""
SQL["zone_slots"] = f"select d::date as day, {slot_of('d')} as slot, (epoch({local(slot_of('d'))}) - epoch({slot_of('d')}))::bigint as zone_offset from generate_series(timestamp '2024-01-01', timestamp '2024-12-31', interval 1 day) g(d)"

# --- evaluation ---
_t = judged(MEMBERS, MEMBER_COLS)
_t.set(tok=Q.tokens("x"), opinion=Q.opinion("x") + "::int", sensational=Q.sensationalism("title"), path=Q.url_path("coalesce(link, '')"))
_s = f"s{len(_t.steps) - 1}"
_t.over(
    f"""select u.*, coalesce(k.core, []) as core from {{s}} u left join (select cluster_ix, list(term) as core from
  (select t.cluster_ix, t.term, count(*) as c, any_value(n.n) as n from (select cluster_ix, unnest(list_distinct(tok)) as term from {_s} where newsworthy) t join (select cluster_ix, count(*) as n from {_s} where newsworthy group by all) n using (cluster_ix) group by all)
  where c >= greatest(2, ceil(n * 0.4e0)) group by cluster_ix) k on k.cluster_ix = u.cluster_ix""",
    "cluster_ix",
)
_t.set(rep="case when len(core) = 0 then 1e0 else len(list_intersect(list_distinct(tok), core)) / len(core)::double end")
SQL["triage_members"] = _t.done("cluster_ix, member_ix, newsworthy as admitted, opinion, sensational, path, round(rep, 6) as representative, (row_number() over (partition by cluster_ix order by rep desc, sensational, member_ix))::int as place")

# --- streams ---
SQL["stream_volume"] = "select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 4) as total from events group by all"
SQL["stream_first_of_day"] = "select user_id, event_type, strftime(ts, '%Y-%m-%d') as day, arg_min(event_id, (ts, event_id)) as event_id from events group by all"
