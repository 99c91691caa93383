"""Structured Streaming queries over replayed tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.catalog.ingest import SPARSE, sparse_lines, sparse_summary
from driftloom.catalog.inputs import BATCHES, EVENTS, events, query, r6, scratch, vectors
from driftloom.catalog.sequences import CUT, ORDER, WINDOWS, WS, faded_sql
from driftloom.operators.ranks import order_buckets
from driftloom.sources.ordered import ordered_stream
from driftloom.streaming import drift_loop as loop
from driftloom.streaming import pipelines as P

SLICES = ("2024-01-11", "2024-01-21", "2100-01-01")


#: Rows of a micro-batch, about, and the least number of micro-batches.
BATCH_ROWS = 4_000_000
LEAST = 3


def numbered_stream(spark, rows: DataFrame, number: Column) -> DataFrame:
    """A table as a stream whose micro-batches are the rows of equal ``number``, in its order; each is as many files as
    its size asks for, written by as many tasks."""
    folder = scratch(spark, "stream")
    rows.withColumn("number", number).hint("rebalance", "number").write.partitionBy("number").parquet(folder)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    return ordered_stream(spark, folder, schema)


def event_stream(spark, sf) -> DataFrame:
    """The events in time order, in micro-batches of a bounded number of rows."""
    e = events(spark, sf)
    n = max(LEAST, math.ceil(e.count() / BATCH_ROWS))
    cut = order_buckets(e, ORDER, n, "at")
    return numbered_stream(spark, cut, F.col("at")).drop("at")


def slice_stream(spark, sf) -> DataFrame:
    """The events in micro-batches that end at given days."""
    number = F.lit(len(SLICES) - 1)
    for i, end in reversed(list(enumerate(SLICES[:-1]))):
        number = F.when(F.col("ts") < F.lit(end).cast("timestamp"), i).otherwise(number)
    return numbered_stream(spark, events(spark, sf), number)


@query("stream_tumbling_windows", """SELECT time_bucket(INTERVAL '8 hours', ts) AS window_start, event_type, round(avg(value), 6) AS avg_value,
  round(sum(value), 6) AS sum_value FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf):
    specs = [("avg_value", "avg", "value"), ("sum_value", "sum", "value")]
    agg = P.tumbling(event_stream(spark, sf), specs, ["event_type"], "ts")
    flat = agg.select(F.col("window.start").alias("window_start"), "event_type", "avg_value", "sum_value")
    out = P.replay_latest(flat, ["window_start", "event_type"], "tumbling")
    return out.select("window_start", "event_type", r6("avg_value"), r6("sum_value"))


@query("stream_closed_windows", """SELECT * FROM (SELECT time_bucket(INTERVAL '8 hours', ts) AS window_start, event_type, round(sum(value), 6) AS sum_value
  FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_closed(spark, sf):
    agg = P.tumbling(event_stream(spark, sf), [("sum_value", "sum", "value")], ["event_type"], "ts")
    flat = agg.select(F.col("window.start").alias("window_start"), "event_type", "sum_value")
    return P.replay(flat, "closed").select("window_start", "event_type", r6("sum_value"))


@query("stream_sliding_windows", f"""{WINDOWS} SELECT CELL, END_TIME, event_id, vs[1] AS first_value, round(list_sum(vs), 6) AS sum_value,
  round(list_sum(ks), 6) AS sum_k FROM w WHERE n = {WS}""")
def stream_sliding(spark, sf):
    s = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("CELL"), F.col("ts").alias("DATETIME"), "event_id", "value", "k")
    out = P.sliding(s, "CELL", "DATETIME", ["value", "k"], WS, "event_id")

    def part(i):
        return F.aggregate("win", F.lit(0.0), lambda a, r: a + r[i])

    return out.select("CELL", "END_TIME", "event_id", F.col("win")[0][0].alias("first_value"), r6(part(0), "sum_value"), r6(part(1), "sum_k"))


@query("stream_prequential_scores", faded_sql("event_type") + """ SELECT event_type, event_id, round(recall, 6) AS recall,
  round(specificity, 6) AS specificity, round(sqrt(recall * specificity), 6) AS gmean FROM s""")
def stream_prequential(spark, sf):
    s = event_stream(spark, sf).withColumn("pred", (F.col("score") >= CUT).cast("int"))
    out = P.faded_counters(s, "event_type", ORDER)
    return out.select("event_type", "event_id", r6("recall"), r6("specificity"), r6("gmean"))


@query("stream_batch_counts", f"""SELECT CAST(CASE WHEN ts < TIMESTAMP '{SLICES[0]}' THEN 0 WHEN ts < TIMESTAMP '{SLICES[1]}' THEN 1 ELSE 2 END AS INTEGER) AS batch,
  count(*) AS n, sum(label) AS anomalies FROM ({EVENTS}) GROUP BY batch""")
def stream_batches(spark, sf):
    path = scratch(spark, "batch-counts")

    def store(rows: DataFrame, number: int) -> None:
        out = rows.agg(F.count("*").alias("n"), F.sum("label").alias("anomalies")).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{path}/part={number}")

    P.for_each_batch(slice_stream(spark, sf), store, "counts")
    return spark.read.option("basePath", path).parquet(path).select("batch", "n", "anomalies")


@query("stream_drift_loop")
def stream_drift_loop(spark, sf):
    v = vectors(spark, sf)
    return loop.drift_loop(numbered_stream(spark, v, F.col("batch")), ["vec_id"])


@query("stream_libsvm_batches", f"""SELECT dense_rank() OVER (ORDER BY batch) - 1 AS step, * FROM ({SPARSE})""")
def stream_libsvm_batches(spark, sf):
    """Batch files written in no order, beside one that is no batch, replayed by their numbers."""
    folder, path = scratch(spark, "batch-files"), scratch(spark, "batch-sums")
    lines = sparse_lines(spark, sf)
    for n in sorted(range(1, BATCHES + 1), key=lambda n: str(n * 7 % 11)):
        lines.where(F.col("batch") == n).select("value").write.text(f"{folder}/batch{n}.dat")
    lines.where(F.col("batch") == 1).select("value").write.text(f"{folder}/notes.dat")

    def store(rows: DataFrame, number: int) -> None:
        sparse_summary(rows).withColumn("step", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={number}")

    P.for_each_batch(P.libsvm_stream(spark, folder), store, "libsvm")
    return spark.read.option("basePath", path).parquet(path).select("step", "batch", "label", "n", "total", "width")
