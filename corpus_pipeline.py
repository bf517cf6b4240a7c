"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._common import stash, table
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import in_order, mixed
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality_filter
from tidemark.llm.simhash import simhash_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior quality is under quality.THRESHOLD go."""
    return quality_filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays."""
    return line_dedup(docs, short=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles one stays."""
    return simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return in_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places, the sequences in the order of the mix.

    Files may be read in any order, so the places in the mix are made again from the same rows.
    """
    return pack(mixed(docs.select("doc_id", "text", "source")), order="mix_position")


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_documents), ("pfair_mix", mix_sources), ("best_fit_packing", pack_sequences)]

#: SQL cannot express the expectation-maximisation, the fingerprints and the tokens; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
