"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import pytest

from tests import compare
from tidemark.plans import catalog

DIR = "/root/testdata/sf0.001"
#: One of each family runs here; `python tests/compare.py FOLDER` runs all of them.
FAMILIES = ["strip_html", "first_sentences", "entities", "clean_urls", "parse_dates", "newsworthy", "unique_outlets", "score_components", "quota_select", "missed_specialists", "atom_entries", "push_messages", "delivery_plans", "zone_slots", "stream_volume"]


@pytest.mark.parametrize("name", FAMILIES)
def test_same_as_sql(spark, name):
    assert compare.difference(spark, compare.duck(DIR), DIR, catalog.QUERIES[name], catalog.ORACLE[name]) == ""


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_whole_texts_are_read(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    read = {r["id"]: r["value"] for r in catalog.QUERIES["without_quotes"](spark, DIR).where("kind = 'document'").collect()}
    assert read.keys() == docs.keys()
    assert sum(len(x or "") for x in read.values()) > 2 * sum(len((x or "").split("\n")[0]) for x in docs.values())
