"""Writers of DuckDB SQL for the oracle: expressions over text, and chains of common table expressions.

Nothing here touches Spark. Only the vocabularies are shared with the operators; the logic is written a second time.
"""

from __future__ import annotations

import re

from tidemark.functions import rules

#: Every Unicode space, for RE2.
SP = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def q(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: q(v) if v is None or isinstance(v, str) else str(v)
    return "(select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as v({names}))"


def re2(p: str) -> str:
    """A rule's pattern for RE2: spaces are Unicode's; \\b is ASCII's anyway."""
    p = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), p)
    out, k, inside = [], 0, False
    while k < len(p):
        if p[k] == "\\":
            two = p[k : k + 2]
            out.append((SP if inside else f"[{SP}]") if two == r"\s" else two)
            k += 2
            continue
        inside = p[k] == "[" or inside and p[k] != "]"
        out.append(p[k])
        k += 1
    return "".join(out)


def sub(c: str, p: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, {q(re2(p))}, {q(to)}, '{flags}')"


def has(c: str, p: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({c}, {q(flags + re2(p))})"


def trim(c: str) -> str:
    return sub(c, r"^\s+|\s+$", "")


def array(words) -> str:
    return "[" + ", ".join(map(q, sorted(words))) + "]"


class Chain:
    """A query grown by columns: each step is a table expression over the one before."""

    def __init__(self, base: str, cols: str):
        self.steps, self.cols = [base], set(cols.split())

    def set(self, **exprs: str) -> Chain:
        old = [c for c in exprs if c in self.cols]
        self.steps.append(f"select *{f' exclude ({", ".join(old)})' if old else ''}, " + ", ".join(f"{e} as {c}" for c, e in exprs.items()) + f" from s{len(self.steps) - 1}")
        self.cols |= set(exprs)
        return self

    def over(self, body: str, cols: str) -> Chain:
        """body: a whole select; {s} stands for the step before."""
        self.steps.append(body.replace("{s}", f"s{len(self.steps) - 1}"))
        self.cols = set(cols.split())
        return self

    def done(self, select: str) -> str:
        return "with " + ",\n".join(f"s{k} as materialized ({s})" for k, s in enumerate(self.steps)) + f"\nselect {select} from s{len(self.steps) - 1}"


def decode(ch: Chain, c: str) -> Chain:
    def numeric(base: str, p: str, code: str) -> str:
        char = f"case when length(regexp_replace(z, '^0+', '')) > 8 then '' when {code} > 1114111 or {code} between 55296 and 57343 then '' else chr(({code})::int) end"
        refs = f"list_transform(regexp_extract_all({c}, {q(p)}, 1), lambda z: {char})"
        return f"case when contains({c}, '&#') then array_to_string(list_transform(list_zip(regexp_split_to_array({c}, {q(p.replace('(', '(?:').replace('(?:?', '(?'))}), {refs}), lambda y: y[1] || coalesce(y[2], '')), '') else {c} end"

    ch.set(**{c: f"coalesce({c}, '')"})
    for _ in range(3):
        ch.set(**{c: numeric("16", "(?i)&#x([0-9a-f]+);", "('0x' || z)::bigint")})
        ch.set(**{c: numeric("10", "&#([0-9]+);", "z::bigint")})
        out = c
        for name, char in rules.REFERENCES.items():
            out = f"regexp_replace({out}, '(?i)&{name};', {q(char)}, 'g')"
        ch.set(**{c: f"case when contains({c}, '&') then {out} else {c} end"})
    return ch


def strip(ch: Chain, c: str) -> Chain:
    """Markup to text. The passes decode once each: three inside three add nothing after the first three."""
    ch.set(**{c: f"coalesce({c}, '')"})
    for _ in range(3):
        bare = c
        for p in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<[^>]*>"):
            bare = f"regexp_replace({bare}, {q(p)}, ' ', 'g')"
        ch.set(**{c: bare})
        decode(ch, c)
    ch.set(**{c: sub(c, r"\s+", " ")})
    ch.set(**{c: sub(c, r"(?i)\s+(['’](?:d|ll|re|s|t|ve)\b)", r"\1")})
    return ch.set(**{c: trim(sub(sub(c, r"\s+([,.;:!?%)\]])", r"\1"), r"([(\[])\s+", r"\1"))})


def clean_description(ch: Chain, c: str) -> Chain:
    strip(ch, c)
    for p in rules.BOILERPLATE:
        ch.set(**{c: f"regexp_replace({c}, {q(re2(p))}, ' ')"})
    return ch.set(**{c: trim(sub(c, r"\s+", " "))})


def truncate(ch: Chain, c: str, most: int) -> Chain:
    ch.set(**{c: trim(f"coalesce({c}, '')")})
    ch.set(_h=f"left({c}, {most})")
    ch.set(_p="case when contains(_h, ' ') then length(_h) - strpos(reverse(_h), ' ') else -1 end")
    return ch.set(**{c: f"case when length({c}) <= {most} then {c} else " + sub(f"case when _p > {most} * 0.6e0 then left(_h, _p) else _h end", r"[\s,;:.–—-]+$", "") + " || '…' end"})


def dangling(ch: Chain, c: str, at_start: bool) -> Chain:
    ends, tail = (r"^\s+", r"^[,;:–—-]+") if at_start else (r"\s+$", r"[,;:–—-]+$")
    ch.set(**{c: sub(c, ends, "")})
    for _ in range(2):
        for a, b in ('""', "“”", "‘’", "()", "[]"):
            mark, other = (b, a) if at_start else (a, b)
            n = lambda m: f"(length({c}) - length(replace({c}, {q(m)}, '')))"
            odd = f"{n(a)} % 2 = 1" if a == b else f"{n(mark)} > {n(other)}"
            rest = f"substr({c}, 2)" if at_start else f"left({c}, length({c}) - 1)"
            here = f"{'starts_with' if at_start else 'ends_with'}({c}, {q(mark)})"
            ch.set(**{c: f"case when {here} and {odd} then {sub(sub(sub(rest, ends, ''), tail, ''), ends, '')} else {c} end"})
    return ch


def first_sentences(ch: Chain, c: str, count: int, most: int) -> Chain:
    ch.set(**{c: trim(f"coalesce({c}, '')")})
    ch.set(**{c: sub(c, r"\b([A-Za-z])\.", "\\1\u0001")})
    # RE2 knows no lookahead: a digit after the period is taken along, so neighbours need two rounds.
    for _ in range(2):
        ch.set(**{c: sub(c, r"([0-9])\.([0-9])", "\\1\u0001\\2")})
    ch.set(**{c: sub(c, r"(?i)\b(" + "|".join(rules.ABBREVIATIONS) + r")\.", "\\1\u0001")})
    # An end of a sentence is marked by what follows it.
    ch.set(_m=sub(c, r"([.!?])(\s|$)", "\\1\u0002\\2"))
    ch.set(_l="regexp_extract_all(_m, " + q("[^.!?\u0002]+[.!?]+\u0002|[^.!?\u0002]+$") + ")")
    ch.set(**{c: f"replace(case when len(_l) > 0 then array_to_string(_l[1:{count}], ' ') else {c} end, '\u0002', '')"})
    ch.set(**{c: f"replace({trim(sub(c, r'\s+', ' '))}, '\u0001', '.')"})
    return dangling(truncate(dangling(ch, c, True), c, most), c, False)


def stems(words: str) -> str:
    """Stems of a list; a word of three letters is marked and left alone."""
    plural = "case when length(w) <= 3 then '=' || w when length(w) > 4 and ends_with(w, 'ies') then left(w, length(w) - 3) || 'y' when ends_with(w, 'sses') then left(w, length(w) - 2) when ends_with(w, 's') and not regexp_matches(w, '(?:ss|us|is)$') then left(w, length(w) - 1) else w end"
    ending = "case when starts_with(w, '=') then w when length(w) > 6 and ends_with(w, 'ing') then left(w, length(w) - 3) when length(w) > 5 and ends_with(w, 'ed') then left(w, length(w) - 2) else w end"
    final = "case when starts_with(w, '=') then substr(w, 2) when length(w) >= 5 and ends_with(w, 'e') then left(w, length(w) - 1) else w end"
    return f"list_transform(list_transform(list_transform({words}, lambda w: {plural}), lambda w: {ending}), lambda w: {final})"


def tokens(c: str) -> str:
    """Stems of the words of a plain text."""
    raw = f"regexp_split_to_array(regexp_replace(regexp_replace(lower({c}), '[‘’'']', '', 'g'), '[^a-z0-9-]', ' ', 'g'), '[ -]+')"
    return stems(f"list_filter({raw}, lambda w: length(w) >= 3 and not list_contains({array(rules.STOPWORDS)}, w) and not regexp_full_match(w, '[0-9][0-9][0-9]'))")


def without_quotes(c: str) -> str:
    out = f"coalesce({c}, '')"
    for p in ('"[^"]{2,120}"', "“[^”]{2,120}”", "‘[^’]{2,120}’"):
        out = f"regexp_replace({out}, {q(p)}, ' ', 'g')"
    return sub(out, r"(^|\s)'([^']{2,60})'([^A-Za-z0-9_]|$)", r"\1 \3")


def title_case(ch: Chain, c: str, to: str) -> Chain:
    """c: a plain text."""
    ch.set(_q=without_quotes(c))
    ch.set(_w=f"list_filter(list_transform(regexp_split_to_array(_q, {q(f'[{SP}]+')}), lambda w: regexp_replace(w, '[^A-Za-z'']', '', 'g')), lambda w: length(w) >= 4 and not regexp_full_match(w, '[A-Z]+'))")
    return ch.set(**{to: "len(_w) >= 5 and len(list_filter(_w, lambda w: regexp_matches(w, '^[A-Z]'))) >= len(_w) * 0.8e0"})


def entities(ch: Chain, c: str, to: str) -> Chain:
    """c: a plain text."""
    title_case(ch, c, "_tc")
    word = r"[A-Z][A-Za-z0-9_'&.-]*"
    run = rf"\b({word}(?:\s+(?:and|de|del|der|of|the|van|von)\s+{word}|\s+{word})*)"
    stop = array(rules.STOPWORDS)
    good = f"lambda w: length(w) >= 3 and not list_contains({stop}, w)"
    norm = f"lower({trim('p')})"
    of = f"list_concat(list_filter([{norm}], {good}), case when contains(p, ' ') then list_filter(regexp_split_to_array({norm}, {q(f'[{SP}]+')}), {good}) else [] end)"
    ch.set(_a=f"list_filter(list_transform(regexp_extract_all({c}, {q(r'\b[A-Z][A-Z0-9]{1,5}\b')}), lambda a: lower(a)), lambda a: not list_contains({stop}, a))", _r=f"flatten(list_transform(regexp_extract_all({c}, {q(re2(run))}, 1), lambda p: {of}))")
    ch.set(_e="case when _tc then _a else _r end")
    # The first of each, in order.
    return ch.set(**{to: "list_filter(_e, lambda x, i: list_position(_e, x) = i)"})


def sensationalism(c: str) -> str:
    t = f"coalesce({c}, '')"
    score = lambda cond, n: f"case when {cond} then {n}e0 else 0e0 end"
    parts = [score(has(t, p), 3) for p in rules.LOADED] + [score(has(without_quotes(t), rules.ESCALATING), 3), score(f"contains({t}, '!')", 2), score(f"ends_with({t}, '?')", 1.5)]
    parts += [f"len(regexp_extract_all({t}, {q(r'\b[A-Z]{5,}\b')})) * 2e0", score(f"regexp_matches({trim(t)}, {q('^[\'\"“]')})", 1.5), score(has(t, r"\b(?:ANALYSIS|BREAKING|EXCLUSIVE|LIVE|OPINION|WATCH)\b\s*[:|-]"), 2.5)]
    parts += [score(f"length({t}) < 30", 1.5), score(f"length({t}) > 130", 1.5), score(has(t, r"^[^:]{0,22}:\s"), 0.75)]
    return "(" + " + ".join(parts) + ")"


def opinion(plain: str) -> str:
    return "(" + " + ".join(f"case when {has(plain, p)} then {w} else 0 end" for p, w in rules.OPINION_SIGNALS) + ")"


SHAPE = r"(?is)^([a-z][a-z0-9+.-]*)://([^/?#\\]+)([^?#]*)(\?[^#]*)?(?:#.*)?$"


def url_path(c: str) -> str:
    return f"case when regexp_matches({c}, {q(SHAPE)}) then coalesce(nullif(regexp_extract({c}, {q(SHAPE)}, 3), ''), '/') else '' end"


def clean_url(ch: Chain, c: str) -> Chain:
    decode(ch, c)
    ch.set(**{c: trim(c)})
    tracks = f"(?i)^(?:(?:{'|'.join(rules.TRACKING_NAMES)})$|(?:{'|'.join(rules.TRACKING_STARTS)}))"
    ch.set(_q=f"array_to_string(list_filter(string_split(substr(regexp_extract({c}, {q(SHAPE)}, 4), 2), '&'), lambda p: p <> '' and not regexp_matches(regexp_extract(p, '^([^=]*)', 1), {q(tracks)})), '&')")
    return ch.set(**{c: f"case when regexp_matches({c}, {q(SHAPE)}) and lower(regexp_extract({c}, {q(SHAPE)}, 1)) in ('http', 'https') then 'https://' || lower(regexp_extract({c}, {q(SHAPE)}, 2)) || {url_path(c)} || case when _q <> '' then '?' || _q else '' end else '' end"})


def title_key(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '', 'g')"


def stable_id(title: str, newest: str) -> str:
    h = f"list_reduce(list_transform(list_filter(string_split({title_key(title)}, ''), lambda x: x <> ''), lambda x: ascii(x)::bigint), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::bigint)"
    digits = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((z // {36**k}) % 36)::int + 1, 1)" for k in range(6, -1, -1))
    return f"coalesce(strftime({newest}, '%Y-%m-%d'), 'undated') || '-' || list_transform([{h}], lambda z: ltrim({digits}, '0'))[1]"


def xml(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), {q(r'[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]')}, '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def soft(c: str) -> str:
    return "(" + " or ".join(has(f"coalesce({c}, '')", p) for p in rules.SOFT_NEWS) + ")"
