"""Addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import decode_entities, let, trim

SHAPE = r"(?is)^([a-z][a-z0-9+.-]*)://([^/?#\\]+)([^?#]*)(\?[^#]*)?(?:#.*)?$"


def url_path(url: Column) -> Column:
    """The path of an absolute url (at least /); empty for what is none."""
    return F.when(url.rlike(SHAPE), let(F.regexp_extract(url, SHAPE, 3), lambda p: F.when(p == "", "/").otherwise(p))).otherwise("")


def clean_url(url: Column) -> Column:
    """An http(s) url as https, without tracking parameters and fragment; empty for what is none."""
    tracks = f"(?i)^(?:(?:{'|'.join(rules.TRACKING_NAMES)})$|(?:{'|'.join(rules.TRACKING_STARTS)}))"

    def clean(u: Column) -> Column:
        query = F.substring(F.regexp_extract(u, SHAPE, 4), 2, 1 << 30)
        kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(tracks)), "&")
        whole = F.concat(F.lit("https://"), F.lower(F.regexp_extract(u, SHAPE, 2)), url_path(u), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
        return F.when(u.rlike(SHAPE) & F.lower(F.regexp_extract(u, SHAPE, 1)).isin("http", "https"), whole).otherwise("")

    return let(trim(decode_entities(url)), clean)
