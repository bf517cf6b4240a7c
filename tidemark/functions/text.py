"""Text functions as columns: all run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import rules

#: Unicode's spaces within a class, spelt out: Java tests that in a third of the time that \h, \v and && take.
SPACES = r"\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same one by one, for what goes by characters instead of patterns.
SPACE_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: An ASCII word boundary; where a word has to follow, its first half says as much and is tested fast.
BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
STARTS = re.compile(r"\(|\[A-Z|[A-Za-z0-9]")


def pattern(p: str) -> str:
    """A rule's pattern for the JVM. What a rule has after `\\b(` begins with a word."""
    out, k = [], 0
    while k < len(p):
        two = p[k : k + 2]
        if two == r"\b":
            out.append(r"(?<!\w)" if STARTS.match(p, k + 2) else BOUNDARY)
        elif two == r"\s":
            out.append(f"[{SPACES}]")
        elif two[0] == "\\":
            out.append(two)
        elif two[0] == "[":  # a whole class; spaces in it stand beside its other members
            m = CLASS.match(p, k)
            out.append(f"(?:[{SPACES}]|[{m[1].replace(chr(92) + 's', '')}])" if r"\s" in m[1] else m[0])
            k = m.end()
            continue
        else:
            out.append(two[0])
            k += 1
            continue
        k += 2
    return "".join(out)


CLASS = re.compile(r"\[((?:\\.|[^\]\\])+)\]")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def passes(text: Column, step: Callable[[Column], Column], n: int = 3) -> Column:
    """step applied n times (null: empty), as one expression however deep step is."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.coalesce(text, F.lit("")), lambda x, _: step(x))


def matches(text: Column, p: str) -> Column:
    return text.rlike("(?i)" + pattern(p))


def sub(text: Column, p: str, to: str) -> Column:
    return F.regexp_replace(text, pattern(p), to)


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARACTERS))


def collapse(text: Column) -> Column:
    """Runs of spaces as one blank each. Few texts hold other spaces than Latin ones, which go by bytes, not patterns."""
    one = lambda x, c: let(x, lambda y: F.when(y.contains(c), F.replace(y, F.lit(c), F.lit(" "))).otherwise(y))
    single = lambda x: let(reduce(one, "\n\t\x0b\f\r\xa0", x), lambda y: F.when(y.contains("  "), F.regexp_replace(y, "  +", " ")).otherwise(y))
    rare = lambda x: x.rlike(r"[^\x00-\u167f]") & x.rlike(f"[{SPACES}&&[^\\x00-\\xff]]")
    return let(text, lambda x: F.when(rare(x), sub(x, r"\s+", " ")).otherwise(single(x)))


def _character(code: Column) -> Column:
    """The character of a code point; empty for none, surrogates and beyond the last."""
    fine = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def _each(text: Column, p: str, use: Callable[[Column], Column]) -> Column:
    """text with use(group 1) for each match of p."""
    made = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), use)
    return F.array_join(F.zip_with(F.split(text, p, -1), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _numeric(text: Column, p: str, base: int) -> Column:
    def code(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "^0+(?=.)", "")
        return F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("long")).otherwise(-1)

    return let(text, lambda x: F.when(x.contains("&#"), _each(x, p, lambda r: _character(code(r)))).otherwise(x))


def _named(text: Column) -> Column:
    """Named references in one scan: no character that one stands for is part of another, amp's decodes one level."""
    p = f"(?i)&({'|'.join(rules.REFERENCES)});"
    table = F.create_map(*[F.lit(x) for kv in rules.REFERENCES.items() for x in kv])
    return let(text, lambda x: F.when(x.rlike(p), _each(x, p, lambda r: F.element_at(table, F.lower(r)))).otherwise(x))


def decode_entities(text: Column) -> Column:
    """Numeric and common named character references, in three passes for what is encoded twice."""

    def one(x: Column) -> Column:
        return _named(_numeric(_numeric(x, "(?i)&#x([0-9a-f]+);", 16), "&#([0-9]+);", 10))

    return passes(text, lambda x: F.when(x.contains("&"), one(x)).otherwise(x))


def strip_html(text: Column) -> Column:
    """Plain text of markup: tags out, references decoded, in three passes; spaces collapsed and closed up."""

    def step(x: Column) -> Column:
        bare = reduce(lambda t, p: F.regexp_replace(t, p, " "), (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]*+>"), x)
        return decode_entities(F.when(x.contains("<"), bare).otherwise(x))

    out = collapse(passes(text, lambda x: F.when(x.contains("<") | x.contains("&"), step(x)).otherwise(x)))
    # Blanks are single by now, so that their neighbours alone say which of them go.
    return trim(F.regexp_replace(out, r" (?:(?=[,.;:!?%)\]]|['’](?i:d|ll|re|s|t|ve)(?!\w))|(?<=[(\[] ))", ""))


def _says(lowered: Column, signs: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds one of signs: tested far faster than the patterns that need one."""
    return reduce(lambda a, b: a | b, [lowered.contains(x) for x in signs])


def clean_description(text: Column) -> Column:
    """strip_html without what feeds add; of each addition the first goes."""

    def first(t: Column, p: str) -> Column:
        # Patterns with an anchor match once at most; the others are made to by taking what precedes along.
        return sub(t, p, " ") if p.startswith("^") or p.endswith("$") else F.regexp_replace(t, r"(?s)\A(.*?)" + pattern(p) + r"(.*)\z", "$1 $2")

    def less(t: Column) -> Column:
        steps = rules.BOILERPLATE.items()
        out = reduce(lambda x, ps: let(x, lambda y: F.when(_says(F.lower(y), ps[1]), first(y, ps[0])).otherwise(y)), steps, t)
        signs = tuple(x for p, xs in steps if not p.startswith("^") for x in xs)
        # What is anchored to the start of a stripped text starts it; without any sign nothing goes.
        starts = [t.startswith(x) for p, xs in steps if p.startswith("^") for x in xs]
        some = reduce(lambda a, b: a | b, starts, let(F.lower(t), lambda low: _says(low, signs)))
        return F.when(some, trim(collapse(out))).otherwise(t)

    return let(strip_html(text), less)


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters and an ellipsis, cut at a space if one is near the end."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, most)
        space = F.length(head) - F.instr(F.reverse(head), " ")
        base = F.when(head.contains(" ") & (space > most * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
        return F.concat(sub(base, r"[\s,;:.–—-]+$", ""), F.lit("…"))

    return let(trim(F.coalesce(text, F.lit(""))), lambda t: F.when(F.length(t) <= most, t).otherwise(cut(t)))


def _drop_dangling(text: Column, pairs: list[tuple[str, str]], at_start: bool) -> Column:
    """pairs: (the mark at that end, its partner). The mark goes if it has no partner."""
    ends = r"^\s+" if at_start else r"\s+$"

    tail = r"^[,;:–—-]+" if at_start else r"[,;:–—-]+$"

    def one(x: Column, pair: Column) -> Column:
        count = lambda mark: F.length(x) - F.length(F.replace(x, mark, F.lit("")))
        odd = F.when(pair["a"] == pair["b"], count(pair["a"]) % 2 == 1).otherwise(count(pair["a"]) > count(pair["b"]))
        here = F.startswith(x, pair["a"]) if at_start else F.endswith(x, pair["a"])
        rest = F.substring(x, F.lit(2), F.length(x)) if at_start else F.substring(x, F.lit(1), F.length(x) - 1)
        return F.when(here & odd, sub(sub(sub(rest, ends, ""), tail, ""), ends, "")).otherwise(x)

    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs * 2])
    return F.aggregate(rows, sub(F.coalesce(text, F.lit("")), ends, ""), one)


QUOTES = [('"', '"'), ("“", "”"), ("‘", "’"), ("(", ")"), ("[", "]")]


def drop_dangling_closer(text: Column) -> Column:
    return _drop_dangling(text, [(b, a) for a, b in QUOTES], True)


def drop_dangling_opener(text: Column) -> Column:
    return _drop_dangling(text, QUOTES, False)


def first_sentences(text: Column, count: int, most: int) -> Column:
    """The first sentences, at most so long; periods of initials, decimals and abbreviations end none."""
    words = "|".join(rules.ABBREVIATIONS)
    # A stretch is text up to a mark that may end it; those that no space follows belong to no sentence.
    stretch = rf"(?:[^.!?]++|\.(?:(?<=(?<!\w)[A-Za-z]\.)|(?<=[0-9]\.)(?=[0-9])|(?<=(?<!\w)(?i:{words})\.)))++"
    sentence = rf"[.!?]*+(?:{stretch}[.!?]++(?![{SPACES}]|\z))*+{stretch}(?:[.!?]++|\z)"

    def read(head: Column) -> Column:
        masked = sub(head, r"\b([A-Za-z])\.", "$1\u0001")
        masked = F.regexp_replace(masked, r"([0-9])\.(?=[0-9])", "$1\u0001")
        masked = sub(masked, rf"(?i)\b({words})\.", "$1\u0001")
        return F.replace(trim(collapse(let(masked, joined))), F.lit("\u0001"), F.lit("."))

    def joined(m: Column) -> Column:
        parts = F.regexp_extract_all(m, F.lit(rf"(?<![^.!?])[^.!?]++(?:[.!?]++(?=[{SPACES}]|\z)|\z)"), F.lit(0))
        return F.array_join(F.slice(F.when(F.size(parts) > 0, parts).otherwise(F.array(m)), 1, count), " ")

    def first(out: Column) -> Column:
        # Where the last sentence wanted ends, reading may stop; a text of fewer is read whole.
        head = F.regexp_extract(out, rf"\A(?:{sentence}){{{count}}}+", 0)
        whole = read(let(head, lambda h: F.when(h == "", out).otherwise(h)))
        return F.when(out == "", "").otherwise(drop_dangling_opener(truncate(drop_dangling_closer(whole), most)))

    return let(trim(F.coalesce(text, F.lit(""))), first)


def stem(word: Column) -> Column:
    """A light stem: plural, -ing or -ed, then a final e."""
    less = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    plural = (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(less(word, 3), F.lit("y")))
        .when(word.endswith("sses"), less(word, 2))
        .when(word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), less(word, 1))
        .otherwise(word)
    )
    ending = lambda w: F.when((F.length(w) > 6) & w.endswith("ing"), less(w, 3)).when((F.length(w) > 5) & w.endswith("ed"), less(w, 2)).otherwise(w)
    final = lambda w: F.when((F.length(w) >= 5) & w.endswith("e"), less(w, 1)).otherwise(w)
    return F.when(F.length(word) <= 3, word).otherwise(let(let(plural, ending), final))


def _stop(word: Column) -> Column:
    return word.isin(sorted(rules.STOPWORDS))


def tokenize(text: Column, stripped: bool = False) -> Column:
    """Stems of the words of three letters or more that carry a topic, in order, repeats included."""
    plain = text if stripped else strip_html(text)
    bare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), "‘’'", F.lower(plain))
    number = lambda w: (F.length(w) == 3) & (w < ":") & w.rlike("^[0-9]{3}$")
    kept = F.filter(F.split(bare, "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~_stop(w) & ~number(w))
    return let(F.array_join(kept, " "), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(_stems(x), " ")))


def _stems(words: Column) -> Column:
    """stem of each of the words, of a to z and digits with a blank between: by patterns over all of them at once."""
    out = F.regexp_replace(words, r"ies(?= |\z)(?<=[^ ]{2}ies)", "y")
    out = F.regexp_replace(out, r"(?:s(?= |\z)(?<=[^ ]{3}s)(?<![sui]s)|es(?= |\z)(?<=sses))", "")
    out = F.regexp_replace(out, r"(?:ing(?= |\z)(?<=[^ ]{4}ing)|ed(?= |\z)(?<=[^ ]{4}ed))", "")
    return F.regexp_replace(out, r"e(?= |\z)(?<=[^ ]{4}e)", "")


def without_quotes(text: Column) -> Column:
    """Text without quoted spans; straight single quotes count only where they can't be an apostrophe."""
    out = F.coalesce(text, F.lit(""))
    for p in ('"[^"]{2,120}"', "“[^”]{2,120}”", "‘[^’]{2,120}’"):
        out = F.regexp_replace(out, p, " ")
    return F.regexp_replace(out, rf"'(?<=(?:\A|[{SPACES}])')[^']{{2,60}}'(?!\w)", " ")


def is_title_case(text: Column, stripped: bool = False) -> Column:
    """Whether at least five words of four letters or more stand outside quotes and four in five begin with a capital."""
    plain = without_quotes(text if stripped else strip_html(text))
    count = lambda x, p: F.size(F.regexp_extract_all(x, F.lit(p), F.lit(0)))
    first = "[A-Z](?<![A-Za-z'][A-Z])"

    def judged(x: Column) -> Column:
        # Words in capitals alone count neither way.
        loud = F.struct(count(x, "[A-Za-z']{4,}+").alias("all"), count(x, f"{first}[A-Za-z']{{3,}}+").alias("capital"), count(x, f"{first}[A-Z]{{3,}}+(?![A-Za-z'])").alias("loud"))
        return let(loud, lambda n: (n["all"] - n["loud"] >= 5) & (n["capital"] - n["loud"] >= (n["all"] - n["loud"]) * 0.8))

    # All but letters, apostrophes and blanks; as a negated class Java takes seventeen times as long.
    return let(F.regexp_replace(plain, r"[\x00-\x1f!-&(-@\[-`{-\x{10ffff}]++", ""), judged)


def entities(text: Column, stripped: bool = False) -> Column:
    """Names, in lower case: runs of capitalised words and their words; of a title in title case, its acronyms."""
    word = r"[A-Z][\w'&.-]*+"
    # Possessive, as nothing follows: a run of any length needs no stack.
    run = rf"(?=[A-Z])(?<!\w)({word}(?: (?:(?:and|de|del|der|of|the|van|von) )?+{word})*+)"

    def of_run(norm: Column) -> Column:
        good = lambda w: (F.length(w) >= 3) & ~_stop(w)
        return F.filter(F.when(norm.contains(" "), F.concat(F.array(norm), F.split(norm, " "))).otherwise(F.array(norm)), good)

    def found(plain: Column) -> Column:
        acronyms = F.filter(F.transform(F.regexp_extract_all(plain, F.lit(pattern(r"\b[A-Z][A-Z0-9]{1,5}\b")), F.lit(0)), F.lower), lambda a: ~_stop(a))
        runs = F.flatten(F.transform(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(run), F.lit(1)), F.lower)), of_run))
        return F.array_distinct(F.when(is_title_case(plain, True), acronyms).otherwise(runs))

    return let(text if stripped else strip_html(text), found)


def sensationalism(title: Column) -> Column:
    """Lower is plainer: loaded words, escalating verbs outside quotes, shouting, odd lengths and openings."""
    score = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(F.lit(0.0))

    def total(t: Column) -> Column:
        parts = [score(matches(t, p), 3) for p in rules.LOADED]
        parts += [score(matches(without_quotes(t), rules.ESCALATING), 3), score(t.contains("!"), 2), score(t.endswith("?"), 1.5)]
        parts.append(F.size(F.regexp_extract_all(t, F.lit(pattern(r"\b[A-Z]{5,}\b")), F.lit(0))) * F.lit(2.0))
        parts.append(score(trim(t).rlike("^['\"“]"), 1.5))
        parts.append(score(matches(t, r"\b(?:ANALYSIS|BREAKING|EXCLUSIVE|LIVE|OPINION|WATCH)\b\s*[:|-]"), 2.5))
        parts += [score(F.length(t) < 30, 1.5), score(F.length(t) > 130, 1.5), score(matches(t, r"^[^:]{0,22}:\s"), 0.75)]
        return reduce(lambda a, b: a + b, parts)

    return let(F.coalesce(title, F.lit("")), total)


def opinion_score(title: Column) -> Column:
    parts = lambda t: reduce(lambda a, b: a + b, [F.when(matches(t, p), w).otherwise(0) for p, w in rules.OPINION_SIGNALS])
    return let(strip_html(title), parts)


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as a long."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def stable_id(title: Column, newest: Column) -> Column:
    """UTC day of a timestamp (or undated) and the base-36 hash of the title's letters and digits."""
    day = F.coalesce(F.date_format(newest, "yyyy-MM-dd"), F.lit("undated"))
    return F.concat(day, F.lit("-"), F.lower(F.conv(fnv1a(title_key(title)).cast("string"), 10, 36)))


def xml_escape(text: Column) -> Column:
    """For XML 1.0: no control characters, the five reserved ones as references."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), out)


def percent_encode(text: Column) -> Column:
    """As a component of a url, spaces as %20; marks that need none stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")), out)
