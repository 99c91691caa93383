"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.session import settle


def connect(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for every node of ``links`` (a, b).

    Each round a node takes the smallest label among its own and its neighbours', and then the label of its label, so
    the number of rounds is logarithmic in the length of chains in practice. All tables stay on the executors; only
    the number of changes reaches the driver.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = settle(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = settle(hooked.join(jump, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("changed")))
        if new.filter("changed").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
