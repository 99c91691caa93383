"""The given tables in the roles the operators expect, for Spark and for SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.session import checkpoint_root, pin_utc, work_path
from driftloom.sources.schema import OVERLAP

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when given, the SQL that must return the same rows."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            checkpoint_root(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def r6(col: Column | str, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c, 6)
    return out.alias(name or col) if (name or isinstance(col, str)) else out


def r6_off_ties(col: Column | str, name: str | None = None) -> Column:
    """Like r6, moved off exact ties of the sixth digit, which the two engines round apart."""
    return r6((F.col(col) if isinstance(col, str) else col) + 1e-9, name or col)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return work_path(spark, name)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a zoned time, the second measurement ``k`` and score / label roles."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"),
    )


EVENTS = """SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  value AS score, CAST(event_type = 'error' AS INTEGER) AS label FROM events"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements: cell = user, two KPIs."""
    return events(spark, sf).select(
        F.col("ts").alias("DATETIME"), F.col("user_id").cast("string").alias("CELL"), "event_id", "event_type",
        F.col("value").alias("Traffic_Volume_Gbyte"), F.col("k").alias("ERAB_Drop_PC"),
    )


FACTS = """SELECT ts AS DATETIME, CAST(user_id AS VARCHAR) AS CELL, event_id, event_type, value AS Traffic_Volume_Gbyte,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ERAB_Drop_PC FROM events"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour pairs: suppliers at key distance 1..3, overlap from their balances.

    Six candidate keys per supplier and an equi-join; no range join.
    """
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    steps = F.array(*[F.lit(d) for d in (-3, -2, -1, 1, 2, 3)])
    left = s.select("s_suppkey", F.col("s_acctbal").alias("_a"), F.explode(steps).alias("_d"))
    left = left.withColumn("_n", F.col("s_suppkey") + F.col("_d"))
    right = s.select(F.col("s_suppkey").alias("_n"), F.col("s_acctbal").alias("_b"))
    return left.join(right, "_n").select(
        F.col("s_suppkey").cast("string").alias("CELL"), F.col("_n").cast("string").alias("N_CELL"),
        (100 - F.abs(F.col("_a") - F.col("_b")) / 110).alias(OVERLAP),
    )


EDGES = """SELECT CAST(a.s_suppkey AS VARCHAR) AS CELL, CAST(b.s_suppkey AS VARCHAR) AS N_CELL,
  100 - abs(a.s_acctbal - b.s_acctbal) / 110 AS overlap
  FROM supplier a JOIN supplier b ON b.s_suppkey - a.s_suppkey IN (-3, -2, -1, 1, 2, 3)"""

BATCHES = 10


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled 64-wide rows in ten ordered batches."""
    e = table(spark, sf, "embeddings")
    n = max(1, e.count())
    return e.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label",
        F.floor(F.col("vec_id") * BATCHES / n).cast("int").alias("batch"),
    )


VECTORS = f"""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features, label,
  CAST(floor(vec_id * {BATCHES} / (SELECT count(*) FROM embeddings)) AS INTEGER) AS batch FROM embeddings"""

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SPLIT_DATE = "1998-06-01"


def measures(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *MEASURES, F.col("l_shipdate").cast("timestamp").alias("l_shipdate"))


def early_late(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reference = earlier shipments, current = later ones."""
    m = measures(spark, sf)
    cut = F.lit(SPLIT_DATE).cast("timestamp")
    return m.where(F.col("l_shipdate") < cut), m.where(F.col("l_shipdate") >= cut)


EARLY = f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT_DATE}'"
LATE = f"SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT_DATE}'"
EV_CUT = "2024-01-16"


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events before and after the middle of the month."""
    e = events(spark, sf)
    cut = F.lit(EV_CUT).cast("timestamp")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)
