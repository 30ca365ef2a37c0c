"""From documents to training sequences: five stages, each stored before the next one reads it.

Quality first, so that later stages do not compare what is thrown away; exact
copies before near ones, so that the forest meets each text once; personal data
after both, since masking could make different texts equal; packing last.

Every stage takes whole texts.  Null texts count as empty; empty tables, repeated
rows, and further columns with any name pass through every stage but the last.
SQL cannot express the trained classifier, so the pipeline has no SQL and is
tested stage by stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidlens.llm import exact_dedup, near_dedup, packing, pii, quality
from bidlens.llm.queries import word_file
from bidlens.llm.tables import read
from bidlens.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents' labels, does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.mask(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return packing.pack(docs, word_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact dedup", one_of_equal),
    ("near dedup", one_of_similar),
    ("personal data", without_personal_data),
    ("packing", packed_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is stored and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
