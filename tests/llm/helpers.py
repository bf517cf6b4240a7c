"""Small tables with the odd cases that every operator has to take."""

from __future__ import annotations

import random

WORDS = "the of harbour lantern quiet and river stone in meadow bright to winter signal copper ladder morning a basket thunder with garden velvet orbit pilot".split()


def text(seed: int, n: int, lines: int = 1) -> str:
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(n)) for _ in range(lines))


def odd_rows() -> list[tuple]:
    """doc_id, text, lang, source: nulls in each column, empty, blank, long and repeated rows, clashing wording."""
    long_text = text(99, 20000)
    return [
        (1, text(1, 80), "en", "src0"),
        (2, text(1, 80), "en", "src0"),
        (2, text(1, 80), "en", "src0"),
        (3, text(3, 120, 3), "en", "src1"),
        (4, None, "en", "src1"),
        (5, "", None, None),
        (6, " \n\t \n", "fr", "src2"),
        (7, long_text, "en", "src0"),
        (8, long_text + " coda", "en", "src9"),
        (None, text(5, 60), "en", "src3"),
        (10, "###*** %%% &&& " * 40, "xx", "src4"),
        (11, text(11, 90), None, "nowhere"),
        (12, "Ünïcödé 漢字 \U0001f600 " * 30, "de", "src5"),
        (13, text(3, 120, 3) + "\n" + text(1, 80), "en", "src6"),
    ]


SCHEMA = "doc_id long, text string, lang string, source string"


def odd_docs(spark):
    """With columns whose names the operators use inside, too."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    for name in ("_w", "_row", "fp", "component_id", "kept", "_stream", "_rank", "line", "place", "n_words"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
