"""The stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of the documents, whatever further columns these have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textscan.llm import decontamination, packing, pii, quality_rules, simhash
from textscan.llm.batches import read, written
from textscan.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source.  Null, empty and blank texts go;
    null languages and sources are groups of their own; repeated rows are judged alike; whole texts are judged, however
    long; no documents give none."""
    return quality_rules.quality_filter(docs, "text", "lang", "source")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose fingerprints differ in at most 3 bits: that with the smallest id (the
    first as stored among rows that repeat it; rows without an id come last).  Null and blank texts are one class; whole
    texts count, however long; no documents give none."""
    return simhash.drop_near_duplicates(docs, "doc_id", "text")


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.  Null and empty texts, and items without words, meet nothing;
    repeated rows go or stay alike; long texts are searched in stretches; no items leave all documents."""
    return decontamination.drop_contaminated(docs, "text", read(spark, sf_dir, "benchmark"), "item_id", "text")


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind, and ``n_chars`` of the new text.  Null texts
    stay null, empty ones empty; repeated rows change alike; whole texts are read, however long."""
    return pii.redacted(docs, "text", size="n_chars")


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, packed into windows; see ``packing.pack``."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", good_documents),
    ("simhash", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("pii", redacted_documents),
    ("packing", packed_pieces),
]

#: The fingerprints and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
