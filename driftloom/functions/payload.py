"""Batch-scoring payloads as JSON columns (no HTTP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.names import q
from driftloom.operators.ranks import cut_batches

REPLY = "predictions array<struct<anomaly_score:double>>"


def to_payload(df: DataFrame, row: str, order: list[str], rows_per_call: int = 1000) -> DataFrame:
    """One JSON request per ``rows_per_call`` rows, in order; the batch size bounds each text."""
    cut = cut_batches(df.select(*[q(c) for c in order], q(row).alias("_row")), order, rows_per_call, "call")
    rows = F.sort_array(F.collect_list(F.struct(*[q(c) for c in order], F.col("_row"))))
    data = F.transform(rows, lambda r: r["_row"])
    return cut.groupBy("call").agg(F.to_json(F.struct(F.struct(data.alias("data")).alias("dataframe_split"))).alias("payload"))


def from_reply(df: DataFrame, reply: str = "reply", call: str = "call") -> DataFrame:
    """Scores of a reply with their position in the call."""
    parsed = F.from_json(q(reply), REPLY)
    return df.select(q(call), F.posexplode(parsed["predictions"]).alias("pos", "p")).select(
        q(call), "pos", F.col("p.anomaly_score").alias("anomaly_score")
    )
