"""A training corpus from the documents table: quality, near duplicates, personal data, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of ``documents``; the last
one returns the packed pieces. Stages are written as Parquet and read again, so each starts from files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.mixing import mixed
from driftloom.llm.neardup import drop_near_duplicates
from driftloom.llm.packing import pack
from driftloom.llm.pii import redact
from driftloom.llm.quality import keep_good
from driftloom.llm.text import documents
from driftloom.session import checkpoint_root, pin_utc, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text has no words and is rejected; repeated rows get one verdict."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more. Of rows with equal ids one stays, of
    rows without an id one for each text; texts without words are near nothing."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars`` follows the text. A null text stays null, with the
    ``n_chars`` it had; texts of any length are read whole."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants them; a null source is one of its own, documents without words go."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024 tokens. A null text is empty: one piece with its end token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packing),
]

#: Estimated classes, components and bins can't be said in SQL; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    checkpoint_root(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
