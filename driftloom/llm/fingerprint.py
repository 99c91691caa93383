"""Order MinHash fingerprints.

For each of several hash functions the smallest k-mers of a text are selected, where the n-th occurrence of a k-mer
counts as a k-mer of its own. They are put back into text order and hashed together, so a fingerprint changes with the
order of a text's parts and not only with the parts. The share of equal entries of two fingerprints estimates a
similarity that follows the edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftloom.llm.text import column, map_batches, mix, two_columns

K = 12
#: k-mers per entry, and entries per fingerprint.
TUPLE = 2
ENTRIES = 32
#: k-mers looked at in one step; bounds a task's memory for very long texts.
STRETCH = 1 << 13
#: Stands for null below all ids.
NO_ID = -(1 << 63)

_ODD = (mix(np.arange(ENTRIES, dtype=np.uint64), 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(ENTRIES, dtype=np.uint64), 12) >> np.uint64(32)).astype(np.uint32)
_BASE = 0x9FB21C651E98DF25
_BITS = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of every k-mer; a text shorter than k is one k-mer."""
    if not len(points):
        return np.zeros(0, np.uint64)
    h = mix(points.astype(np.uint64), 3)
    width, out, at, factor = 1, None, 0, _BASE  # the factor differs for each width
    k = min(k, len(points))
    while True:  # k as a sum of powers of two: hashes of doubled width are built from their halves
        if k & width:
            if out is None:
                out = h
            else:
                n = len(points) - at - width + 1
                out = out[:n] * np.uint64(factor) + h[at : at + n]
            at += width
        if at == k:
            return mix(out, len(points) if len(points) < K else 0)
        h = h[:-width] * np.uint64(factor) + h[width:]
        width *= 2
        factor = (factor * factor + 2) & _BITS


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes in which the second, third, ... occurrence of a k-mer differs from the first."""
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return h
    again = np.unique(again)
    slot = np.minimum(np.searchsorted(again, h), len(again) - 1)
    where = np.flatnonzero(again[slot] == h)
    by = where[np.argsort(slot[where], kind="stable")]
    group = slot[by]
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    number = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    out = h.copy()
    out[by] = mix(h[by] + number.astype(np.uint64) * np.uint64(_BASE), 4) * (number > 0) + h[by] * (number == 0)
    return out


def smallest(x: np.ndarray, count: int) -> np.ndarray:
    """Positions of the ``count`` smallest values under each hash function (entries x count), in text order."""
    best_value = np.full((ENTRIES, 0), 0, np.uint32)
    best_at = np.zeros((ENTRIES, 0), np.int64)
    rows = np.arange(ENTRIES)
    for s in range(0, len(x), STRETCH):
        part = x[s : s + STRETCH]
        values = _ODD[:, None] * part + _ADD[:, None]
        for _ in range(min(count, len(part))):
            at = values.argmin(axis=1)
            best_value = np.column_stack([best_value, values[rows, at]])
            best_at = np.column_stack([best_at, at + s])
            values[rows, at] = 0xFFFFFFFF
        if best_value.shape[1] > count:
            keep = np.argsort(best_value, axis=1, kind="stable")[:, :count]
            best_value, best_at = np.take_along_axis(best_value, keep, 1), np.take_along_axis(best_at, keep, 1)
    return np.sort(best_at, axis=1)


def fingerprint(points: np.ndarray) -> np.ndarray:
    """``ENTRIES`` 32-bit entries; all zero for the empty text."""
    h = numbered(kmer_hashes(points))
    if not len(h):
        return np.zeros(ENTRIES, np.uint32)
    chosen = h[smallest((mix(h, 5) >> np.uint64(32)).astype(np.uint32), min(TUPLE, len(h)))]
    entry = np.zeros(ENTRIES, np.uint64)
    for j in range(chosen.shape[1]):
        entry = mix(entry * np.uint64(_BASE) + chosen[:, j], 6)
    return np.maximum((entry >> np.uint64(32)).astype(np.uint32), 1)


def as_text(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (hexadecimal), one row for each input row; null counts as the empty text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [as_text(fingerprint(code_points(t or ""))) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return map_batches(two_columns(df, id_col, text_col), batch, "doc_id long, fingerprint string")


def with_successors(df: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) dealt to tasks in descending order of doc_id, with the first row of the next bucket added
    at the end of each bucket (``tail``), so that every row finds its successor in its own task.

    Buckets are cut at approximate quantiles of the ids; there are a few for each shuffle partition, and only their
    borders and largest ids reach the driver. Null ids come last; rows with equal ids are ordered by their text.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    @pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        """0 for the largest ids; the last one also takes null."""
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="left"))

    below = F.coalesce("doc_id", F.lit(NO_ID))
    placed = df.select("doc_id", "text", bucket(below).alias("bucket"))
    tops = placed.groupBy("bucket").agg(F.max("doc_id")).orderBy("bucket").collect()  # a row per bucket
    # the first rows of a bucket also go to the bucket before it, those of the first one to the last
    before = {NO_ID if r[1] is None else r[1]: tops[k - 1][0] for k, r in enumerate(tops)}

    @pandas_udf("int")
    def guest_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: before.get(i, -1)).astype("int32")

    guest = guest_of(below)
    here = F.struct("bucket", F.lit(0).alias("tail"))
    there = F.struct(F.col("guest").alias("bucket"), F.lit(1).alias("tail"))
    both = F.when(F.col("guest") >= 0, F.array(here, there)).otherwise(F.array(here))
    spread = placed.withColumn("guest", guest).withColumn("at", F.explode(both)).select("doc_id", "text", "at.bucket", "at.tail")
    return spread.repartition(n // 4, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the next text (descending id;
    the first one follows the last). ``near_edited`` and ``near_next`` compare with the edited and with the next text.

    Null counts as the empty text; a table of one row is followed by itself; rows with equal ids follow each other by text.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, id, text, code points, fingerprint)
        for b in batches:
            out = []
            for doc, text, bucket, tail in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                points = code_points(text)
                own = fingerprint(points)
                if held is not None and held[0] == bucket:
                    _, of, before, before_points, before_print = held
                    n = len(before)
                    edited = before[: n - n // 3] + text[: n // 3]
                    changed = fingerprint(np.concatenate([before_points[: n - n // 3], points[: n // 3]]))
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((of, n, digest, as_text(before_print), as_text(changed), likeness(before_print, changed), likeness(before_print, own)))
                held = None if tail else (bucket, doc, text, points, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = with_successors(two_columns(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
