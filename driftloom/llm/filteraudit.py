"""Filter interaction audit by forward-backward path counting on the subset lattice.

What a filter removes depends on the filters that ran before it, but only on which they were, not on their order. So all
orders of the filters are paths through the lattice of subsets, from none to all, and a filter's step in an order is an
edge: from the state ``S`` of filters that ran to ``S`` with one more. Counting the paths that reach each state (forward)
and those that leave it (backward) says how many orders use an edge, ``forward(S) * backward(S + f)``; a filter's Shapley
sum is the sum of its edges' removals by that weight, and the steps of every single order are read from the same edges.

Documents enter as counts only: one pass turns each into a mask of the filters it fails, and rows are added up by part,
mask and labels. The lattice depends on the number of filters, never on the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.text import WORD, column
from driftloom.session import settle

FILTERS = "ABCDE"
#: Steps of an order carry these counts.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


class Lattice:
    """Subsets of ``n`` filters as bit masks, the paths through each, and the edges between them."""

    def __init__(self, n: int):
        states = range(1 << n)
        size = [s.bit_count() for s in states]
        self.forward, self.backward = [0] * (1 << n), [0] * (1 << n)
        self.forward[0] = self.backward[-1] = 1
        self.edges = [(s, f) for s in sorted(states, key=size.__getitem__) for f in range(n) if not s >> f & 1]
        for s, f in self.edges:  # small states first: all that reaches s is known
            self.forward[s | 1 << f] += self.forward[s]
        for s, f in reversed(self.edges):
            self.backward[s] += self.backward[s | 1 << f]
        self.weight = np.array([self.forward[s] * self.backward[s | 1 << f] for s, f in self.edges], np.int64)
        self.number = {edge: i for i, edge in enumerate(self.edges)}
        masks = np.arange(1 << n)
        before, bit = (np.array(x)[:, None] for x in zip(*[(s, 1 << f) for s, f in self.edges]))
        fails, gone = (masks & bit) > 0, (masks & before) > 0
        # by edge, which masks (columns) are counted
        self.removed, self.redundant = (fails & ~gone).astype(np.int64), (fails & gone).astype(np.int64)
        self.kept, self.unique = (~fails & ~gone).astype(np.int64), (masks == bit).astype(np.int64)

    def orders(self, names: str) -> Iterator[tuple[str, list[int]]]:
        """Each order with the edges it takes."""
        for order in permutations(range(len(names))):
            state, taken = 0, []
            for f in order:
                taken.append(self.number[state, f])
                state |= 1 << f
            yield "".join(names[f] for f in order), taken


def failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D. A text without words fails A alone."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def mask(flags: list[Column]) -> Column:
    out = F.lit(0)
    for i, flag in enumerate(flags):
        out = out.bitwiseOR(F.when(flag, 1 << i).otherwise(0))
    return out


def failing(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of each row of (doc_id, text, source).

    E needs the smallest id of each text: one row per text is aggregated, and joined to the rows on text and id together,
    so copies of one text are not gathered. A row without an id counts as later than all that have one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settle(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask(failures(text)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    same = (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))
    met = rows.join(first.withColumnRenamed("digest", "of"), same, "left")
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("of").isNull(), 16).otherwise(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents with these failures, and those labelled as of quality or as toxic."""
    known = labels.select(column("doc_id").cast("long").alias("of"), column("quality").alias("quality"), column("toxic").alias("toxic"))
    told = known.groupBy("of").agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    met = failed.join(told, F.col("doc_id") == F.col("of"), "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def read_edges(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """The steps of all orders of the filters ``names``, from ``part, mask, n, good, toxic``."""
    lattice = Lattice(len(names))
    orders = list(lattice.orders(names))
    taken = np.array([edges for _, edges in orders])
    step_order = pa.array(np.repeat([o for o, _ in orders], len(names)))
    step = np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))
    step_filter = np.array([f for _, f in lattice.edges])

    def of_part(part: str, table: dict[str, np.ndarray]) -> pa.RecordBatch:
        edge = {k: getattr(lattice, k) @ table["n"] for k in ("kept", "removed", "redundant")}
        edge["unique_fails"], edge["good_lost"], edge["toxic_lost"] = lattice.unique @ table["n"], lattice.removed @ table["good"], lattice.removed @ table["toxic"]
        shapley = np.zeros(len(names), np.int64)
        np.add.at(shapley, step_filter, edge["removed"] * lattice.weight)
        edge["shapley"] = shapley[step_filter]
        columns = [pa.array(edge[c][taken].ravel()) for c in COUNTS]
        return pa.RecordBatch.from_arrays([pa.array([part] * taken.size, pa.string()), step_order, pa.array(step), *columns], ["part", "filter_order", "step", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = {k: np.zeros(1 << len(names), np.int64) for k in ("n", "good", "toxic")}
                for cell in cells:
                    for k in table:
                        table[k][cell["mask"]] = cell[k]
                yield of_part(part, table)

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^filters at most
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``part, filter_order, step`` and counts of documents, a row for each step of each order of the five filters per part.

    ``part`` is the source (null: the empty string, together with sources of that name). Counts are ``kept`` (after the
    step), ``removed`` (by it), ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing its filter
    only), ``good_lost`` and ``toxic_lost`` (removed by it, labelled quality or toxic 1) and ``shapley`` (the filter's
    removals summed over all orders). Every row is a document, repeated rows too; a null text is empty. Labels with no
    document count nothing, repeated or contradicting ones count once as 1, rows without an id have none. Other columns
    of either table are not read. Without documents the result is empty.
    """
    named = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), column(source_col).cast("string").alias("source"))
    return read_edges(mask_counts(failing(named), labels))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), m AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, step, f.f, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE contains(substr(filter_order, 1, step - 1), g.f))::INT AS before
  FROM o, range(1, 6) t(step), f WHERE f.f = substr(filter_order, step, 1)
), r AS (
  SELECT part, filter_order, step::INT AS step, f,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
