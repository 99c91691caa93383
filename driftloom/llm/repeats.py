"""Repeated windows of documents, found in buckets of a minimiser.

A window is a fixed number of units (bytes or words). Its minimiser is the smallest hash among its k-mers; consecutive
windows with the same minimiser form a piece, and equal windows always meet under the same minimiser. So a corpus is
dealt by minimiser, and:

* minimisers that occur once are dropped before anything else travels;
* equal pieces (64 bits of minimiser and 64 bits of digest) are settled as a whole by counting;
* of the pieces that share a minimiser and differ, one copy of each travels as a packed string to the bucket of its
  minimiser, where an exact method finds the windows they share;
* a minimiser with very many different pieces (a passage in very many surroundings) is dealt anew: the pieces are cut
  at fixed distances from the minimiser and keyed by all units that the windows of a cut have in common, at last by the
  whole window. Equal windows still meet, and no bucket grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from xxhash import xxh3_64_intdigest

from driftloom.llm.text import map_batches, mix, slices, two_columns
from driftloom.session import settle

#: Different pieces of one key that an exact method handles in one task.
BUCKET = 1000
#: Documents without an id count as the last ones, told apart by a hash of their text.
NO_ID = (1 << 63) - (1 << 40)
PIECE = "key long, digest long, doc long, start int, windows int, at int"
FIELDS = [f.split()[0] for f in PIECE.split(", ")]
STRING = "key long, doc long, start int, windows int, at int, string binary"
SPAN = "doc long, start int, windows int"
#: Bits of the filter that keeps texts without any span where they are (16 MB); when it is full all texts travel.
FILTER_BITS = 1 << 27

#: Bits for a place within the units that are cut at once.
PLACE_BITS = 23
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)

Bucket = Callable[[list[tuple[int, int, int, bytes]]], Iterator[tuple[int, int, int]]]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) with a number for every document."""
    docs = two_columns(df, id_col, text_col)
    unnamed = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit((1 << 40) - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("doc"), "text")


def covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of ``n`` units are in one of the windows, as booleans."""
    turn = np.zeros(n + 1, np.int32)
    for s in spans:
        turn[min(s["start"], n)] += 1
        turn[min(s["start"] + s["windows"] + window - 1, n)] -= 1
    return np.cumsum(turn)[:n] > 0


def powers(factor: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, factor, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def cut_pieces(kmers: np.ndarray, units: np.ndarray, length: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Pieces of parts that lie one behind the other: (minimiser, digest, part, start in the part, windows, place of the
    minimiser in the piece).

    ``kmers`` has a hash for every k-mer (also for those across parts, which no window uses), ``units`` one for every
    unit, ``length`` the units of each part. Of equal minimisers in a window the first one counts. More units than a
    place has bits for raise an error.
    """
    if len(units) > 1 << PLACE_BITS:
        raise ValueError(f"{len(units)} units at once, at most {1 << PLACE_BITS}")
    n = len(units) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return (none.view(np.uint64), none.view(np.uint64), none, none, none, none)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (kmers & ~low) | np.arange(len(kmers), dtype=np.uint64)
    span, width = window - k + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    place = (np.minimum(least[:n], least[span - width :]) & low).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    long = length >= window
    turn = np.zeros(len(units) + 1, np.int32)
    np.add.at(turn, first[long], 1)
    np.add.at(turn, (first + length - window + 1)[long], -1)
    inside = np.flatnonzero(np.cumsum(turn)[:n] > 0)
    if not len(inside):
        return (none.view(np.uint64), none.view(np.uint64), none, none, none, none)
    place = place[inside]
    # windows of neighbouring parts are at least a window apart
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    start, windows, at = inside[new], np.diff(np.append(new, len(inside))), place[new]
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(_FACTOR, len(units) - 1), out=sums[1:])
    digest = (sums[start + windows + window - 1] - sums[start]) * powers(_INVERSE, len(units))[start]
    part = np.searchsorted(first + length, start, side="right")
    return kmers[at], mix(digest ^ windows.astype(np.uint64), 54), part, start - first[part], windows, at - start


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def piece_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds)], FIELDS)


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit table in which every id of ``ids`` (one long column) has its bit (see ``id_slot``) set."""
    slot = id_slot(F.col(ids.columns[0]))
    words = ids.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("mask"))
    table = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[table["word"].to_numpy()] = table["mask"].to_numpy()
    return bits


def id_slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def is_set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63) & 1).astype(bool)


def probably_in(ids: DataFrame):
    """A column function that is true for every id of ``ids`` (one long column) and false for most others."""
    bits = id_bits(ids)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @pandas_udf("boolean")
    def test(slots):
        import pandas as pd

        return pd.Series(is_set(shared.value, slots.to_numpy()))

    return lambda column: test(id_slot(column))


def counted(pieces: DataFrame, with_string: bool) -> DataFrame:
    """One row per different piece: how often it occurs, and its first occurrence."""
    more = [F.first("string").alias("string")] if with_string else []
    return (
        pieces.groupBy("key", "digest")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first"), F.first("windows").alias("windows"), F.first("at").alias("at"), *more)
        .select("key", "digest", "n", "first.doc", "first.start", "windows", "at", *(["string"] if with_string else []))
    )


def settled_by_count(pieces: DataFrame, different: DataFrame, first_stays: bool) -> DataFrame:
    """Spans of the pieces that occur more than once; the first occurrence stays if ``first_stays``."""
    often = different.filter("n > 1").select(
        F.col("key").alias("k"), F.col("digest").alias("d"), F.col("doc").alias("first_doc"), F.col("start").alias("first_start")
    )
    met = pieces.join(often, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")))
    if first_stays:
        met = met.filter("doc != first_doc or start != first_start")
    return met.select("doc", "start", "windows")


def with_strings(pieces: DataFrame, docs: DataFrame, strings: Callable[[bytes, list], list[bytes]]) -> DataFrame:
    """Adds the packed string of each piece, cut from its document; only texts that are asked for travel."""
    asked = pieces.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "windows", "at")).alias("asked"))  # at most the pieces of one document
    asked = settle(asked)
    wanted = probably_in(asked.select("doc"))
    names = [f.split()[0] for f in STRING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for doc, text, pieces in zip(*(c.to_pylist() for c in b.columns)):
                part = [(p["key"], p["start"], p["windows"], p["at"]) for p in pieces]
                found = strings((text or "").encode(), [(s, n) for _, s, n, _ in part])
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                rows = [(k, doc, s, n, at, string) for (k, s, n, at), string in zip(part, found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    return docs.filter(wanted(F.col("doc"))).join(asked, "doc").select("doc", "text", "asked").mapInArrow(run, STRING)


def recut(strings: DataFrame, size: int, span: int, units: Callable[[bytes], object], glue: Callable[[object], bytes]) -> DataFrame:
    """The windows of each string in cuts of ``size`` by their distance from the minimiser, keyed by what the windows of
    a cut have in common."""
    schema = f"{PIECE}, string binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for _, doc, start, windows, at, string in zip(*(c.to_pylist() for c in b.columns)):
                whole = units(string)
                # window j starts `at - j` units before the minimiser
                for cut in range((at - windows + 1) // size, at // size + 1):
                    far, near = min(cut * size + size - 1, at), max(cut * size, at - windows + 1)
                    core = glue(whole[at - cut * size : at - (cut * size + size - 1) + span]) if size > 1 else b""
                    string = glue(whole[at - far : at - near + span])
                    key = xxh3_64_intdigest(core, cut & 0xFFFF) if size > 1 else xxh3_64_intdigest(string)
                    out.append((signed(key), signed(xxh3_64_intdigest(string, 77)), doc, start + at - far, far - near + 1, far, string))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*FIELDS, "string"])

    return strings.select(*[f.split()[0] for f in STRING.split(", ")]).mapInArrow(run, schema)


def in_buckets(strings: DataFrame, bucket: Bucket, chunk: int) -> DataFrame:
    """Spans found by ``bucket`` among strings that share a key; it gets whole keys, about ``chunk`` bytes at a time."""

    def emit(rows: list) -> Iterator[pa.RecordBatch]:
        spans = list(bucket(rows))
        if spans:
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*spans), kinds)], ["doc", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for key, doc, start, string in zip(*(c.to_pylist() for c in b.columns)):
                if size >= chunk and key != last:
                    yield from emit(held)
                    held, size = [], 0
                held.append((key, doc, start, string))
                size, last = size + len(string), key
        if held:
            yield from emit(held)

    dealt = strings.select("key", "doc", "start", "string").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, SPAN)


def repeated_spans(
    pieces: DataFrame, docs: DataFrame, strings: Callable, bucket: Bucket, span: int, cut: int, first_stays: bool,
    units: Callable = lambda s: s, glue: Callable = lambda u: u, chunk: int = 1 << 20,
) -> DataFrame:
    """``doc, start, windows``: runs of windows that occur elsewhere (earlier, if ``first_stays``).

    ``docs`` has (doc, text); ``strings`` cuts packed strings out of a text; ``bucket`` finds shared windows in strings.
    """
    keys = settle(pieces.groupBy("key").count().filter("count > 1").select("key"))
    met = settle(pieces.join(keys, "key").select(*FIELDS))
    different = settle(counted(met, False))
    spans = [settled_by_count(met, different, first_stays)]
    several = lambda rows: settle(rows.groupBy("key").count().filter("count > 1"))
    left = settle(with_strings(different.join(several(different), "key"), docs, strings))
    for size in (cut, 1):
        sizes = several(left)
        spans.append(in_buckets(left.join(sizes.filter(F.col("count") <= BUCKET), "key"), bucket, chunk))
        hot = left.join(sizes.filter(F.col("count") > BUCKET), "key")
        if hot.isEmpty():
            break
        pieces = settle(recut(hot, size, span, units, glue))
        different = settle(counted(pieces, True))
        spans.append(settled_by_count(pieces, different, first_stays))
        left = different  # single windows have one string a key: all is settled by then
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return settle(out)


def with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may have spans, with their spans (start, windows) as a list, and documents that have none."""
    lists = settle(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("spans")))  # at most the windows of one document
    some = probably_in(lists.select("doc"))
    empty = F.array().cast("array<struct<start:int,windows:int>>")
    joined = docs.filter(some(F.col("doc"))).join(lists, "doc", "left").withColumn("spans", F.coalesce("spans", empty))
    return joined, docs.filter(~some(F.col("doc"))).withColumn("spans", empty)


def by_document(docs: DataFrame, spans: DataFrame, batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``batch`` on (doc, text, spans) of every document. Texts without spans stay where they are, and the task that
    passes them on looks into the bit table itself: no second Python worker stands beside it."""
    lists = settle(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("spans")))  # at most the windows of one document
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(lists.select("doc")))
    kind = "array<struct<start:int,windows:int>>"
    slotted = docs.select("doc", "text", id_slot(F.col("doc")).alias("slot"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(is_set(bits.value, b.column(2).to_numpy()))).select([0, 1])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32())]))
        for b in slices(batches):
            rest = b.filter(pa.array(~is_set(bits.value, b.column(2).to_numpy())))
            if rest.num_rows:
                yield batch(pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array([[]] * rest.num_rows, empty)], ["doc", "text", "spans"]))

    met = slotted.mapInArrow(chosen, "doc long, text string").join(lists, "doc", "left")
    met = met.select("doc", "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    return map_batches(met, batch, schema).unionByName(slotted.mapInArrow(others, schema))
