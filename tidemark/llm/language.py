"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language that labelled training rows name, raw-content zstandard dictionaries are cut from a bounded sample
of them: sample_docs rows by language, the first by md5 of doc_id, sample_chars code points from the middle of each.
A dictionary is the last dict_bytes of its pieces, so the
first of a sample beyond that are left out. At most MOST_LANGS languages are learned, those of most rows; the others
are never predicted. The dictionaries are all that is broadcast. A whole text, in lower case, is compressed once with each; the
smallest size wins, ties going to the language with the larger sample, then by name. score is the margin over the next
language, relative to it; below min_margin the answer is marked as rejected (lang_pred still names the best).

Cases: null texts and texts without a letter are `und` with score 0; rows without lang or doc_id never teach; repeated
rows are predicted each; with no training rows at all every text is `und`; an empty table gives an empty result; other
columns are not read, and lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import table

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 300, 1500, 1 << 18
#: Languages that are learned, those of most rows first: the bound on what is collected and broadcast.
MOST_LANGS = 200
LEVEL, MIN_MARGIN = 3, 0.02
#: A letter: Unicode category L. Python's \w takes numbers like ² and ½ in too, and these are no decimal digits.
WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORD.finditer(text))


def samples(rows: DataFrame, docs: int, chars: int) -> dict[str, list[str]]:
    """For each lang of rows (doc_id, text, lang) at most so many pieces of text; bounded by languages * docs * chars."""
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    piece = F.substring(F.col("text"), 1 + F.greatest(F.lit(0), F.expr(f"(length(text) - {chars}) div 2")).cast("int"), F.lit(chars))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "piece"))
    some = rows.where("lang is not null and doc_id is not null and length(text) > 0")
    # One row for each language, of at most MOST_LANGS. Of a language with many rows only those of the lowest md5 are ranked: about four
    # times as many as are asked for, so a language with most rows isn't ranked in one task.
    sizes = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (4 * docs + 64) / n))]), F.col("lang"))
    low = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32
    some = some.where(F.col("lang").isin(list(sizes))).select("lang", order.alias("order"), piece.alias("piece")).where(low < share)
    out: dict[str, list[str]] = {}
    for r in some.withColumn("k", rank).where(F.col("k") <= docs).orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["piece"])
    return out


def dictionaries(pieces: dict[str, list[str]], most: int) -> dict[str, bytes]:
    return {lang: "\n".join(x).lower().encode()[-most:] for lang, x in pieces.items()}


@functools.lru_cache(maxsize=4)
def compressors(known: tuple[tuple[str, bytes], ...], level: int):
    out = []
    for lang, data in known:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def predict(text: str | None, known: tuple[tuple[str, bytes], ...], level: int = LEVEL) -> tuple[str, float]:
    if not text or not known or not has_letter(text):
        return "und", 0.0
    data = text.lower().encode()
    sizes = [(len(c.compress(data)), k, lang) for k, (lang, c) in enumerate(compressors(known, level))]
    sizes.sort()
    return sizes[0][2], (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0


def languages(docs: DataFrame, train: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES, level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of docs."""
    pieces = samples(train, sample_docs, sample_chars)
    known = dictionaries(pieces, dict_bytes)
    order = sorted(known, key=lambda x: (-len(pieces[x]), x))
    sent = docs.sparkSession.sparkContext.broadcast(tuple((x, known[x]) for x in order))

    def run(batches):
        for pdf in batches:
            found = [predict(t, sent.value, level) for t in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})
            out["rejected"] = out["score"] < min_margin
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = languages(docs, docs.where(~held_out()).select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
