"""The registered query of each corpus operator, with production parameters over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bisector, filteraudit, mixing
from driftloom.llm.bisector import clustered
from driftloom.llm.classlm import score_documents
from driftloom.llm.filteraudit import audit_filters
from driftloom.llm.fingerprint import edit_likeness
from driftloom.llm.itq import near_embeddings
from driftloom.llm.langid import identify_held_out
from driftloom.llm.mixing import mix_sources
from driftloom.llm.neardup import near_duplicates
from driftloom.llm.packing import pack
from driftloom.llm.pii import personal_data, span_digest
from driftloom.llm.quality import quality_verdicts
from driftloom.llm.rlindex import remove_long_repeats
from driftloom.llm.superkmer import remove_repeats
from driftloom.llm.text import documents, embeddings
from driftloom.session import checkpoint_root, pin_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    """Register ``fn`` under its own name."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        checkpoint_root(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(personal_data(documents(spark, sf_dir)))


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), by_size=True).select("doc_id", "size", "source_size", "target", "taken")


SQL["op9_source_mix"] = mixing.SQL


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(documents(spark, sf_dir))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(documents(spark, sf_dir))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2)


@query
def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")


@query
def op1_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_long_repeats(documents(spark, sf_dir)).drop("kept")


@query
def op5_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


@query
def op11_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(embeddings(spark, sf_dir))


SQL["op11_bisector_clusters"] = bisector.sql()


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL["op12_filter_audit"] = filteraudit.SQL


@query
def op13_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(embeddings(spark, sf_dir))
