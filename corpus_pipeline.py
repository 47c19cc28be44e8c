"""A corpus pipeline over ``documents``: language, near copies, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of ``documents``. ``run``
writes each stage's rows to the shared folder and reads them back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import language, mixing, near, packing, pii
from rangeloom.llm.common import materialize, ship, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; texts without a letter go."""
    ship(spark)
    return language.accepted(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of copies and near copies."""
    ship(spark)
    return near.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms generalised or removed from the texts."""
    ship(spark)
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned by their rates, so that the domains' tokens match the target weights."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, laid out in sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", sanitise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers and trained classifiers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
