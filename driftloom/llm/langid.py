"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte bigrams and trigrams (lower case, anything but letters is a blank),
scaled to length one. Document frequencies come from all training texts. Each language is described by several
centroids, found by spherical k-means in a bounded, labelled sample of its texts. A text gets the language of the
centroid with the largest cosine; one that is further from it than nearly all of the centroid's own texts is marked as
rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.text import column
from driftloom.session import settle

#: Number of hashed n-grams; a power of two.
FEATURES = 1 << 13
#: Bound of the labelled sample in which a language's centroids are found: so many different texts, drawn by a digest of the text.
SAMPLE_PER_LANGUAGE = 1500
CENTROIDS = 4
#: Share of a centroid's own sample that may lie outside its radius.
OUTSIDE = 0.01
#: A document whose crc32 of the id leaves this on division by 4 is held out from training.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
BLANK = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
CHUNK = 256


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the text."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(BLANK) + b" ", dtype=np.uint8).astype(np.uint32)
    pairs = raw[:-1] << np.uint32(8) | raw[1:]
    triples = pairs[:-1] << np.uint32(8) | raw[2:] | np.uint32(1 << 30)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    slots = np.concatenate([pairs * np.uint32(2654435761) >> shift, triples * np.uint32(2654435761) >> shift])
    return np.bincount(slots, minlength=FEATURES)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    weighed = np.log1p(np.array([gram_counts(t) for t in texts], dtype=np.float32)) * idf
    return weighed / np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and the centroid of each row. Starts from rows far from each other; rows in given order."""
    centre = [x.mean(axis=0)]
    centre[0] /= max(np.linalg.norm(centre[0]), 1e-12)
    nearest = x @ centre[0]
    seeds = []
    for _ in range(min(k, len(x))):
        seeds.append(x[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, x @ seeds[-1])
    c = np.array(seeds)
    at = np.argmax(x @ c.T, axis=1)
    for _ in range(rounds):
        for j in range(len(c)):
            if (at == j).any():
                total = x[at == j].sum(axis=0)
                c[j] = total / max(np.linalg.norm(total), 1e-12)
        new = np.argmax(x @ c.T, axis=1)
        if (new == at).all():
            break
        at = new
    return c, at


@dataclass
class LanguageModel:
    """Bounded: a vector per centroid, a few centroids per language."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        for s in range(0, len(known), CHUNK):
            part = known[s : s + CHUNK]
            cosine = vectors([texts[i] for i in part], self.idf) @ self.centroids.T
            for i, best, value in zip(part, np.argmax(cosine, axis=1), np.max(cosine, axis=1)):
                names[i], scores[i] = self.languages[best], float(min(max(value, 0.0), 1.0))
                rejected[i] = bool(value < self.radius[best])
        return names, scores, rejected


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def drawn(rows: DataFrame, languages: list[str]) -> DataFrame:
    """At most SAMPLE_PER_LANGUAGE different texts per language, each once: those with the smallest digests.

    Tasks hand on only as many digests per language as are wanted; texts travel when the digests are known.
    """
    name = F.md5("text")
    order = Window.partitionBy("lang").orderBy("name")
    least = rows.select("lang", name.alias("name")).distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_PER_LANGUAGE)
    last = {r.lang: r.last for r in least.groupBy("lang").agg(F.max("name").alias("last")).collect()}
    upto = F.create_map(*[F.lit(v) for lang in languages for v in (lang, last[lang])])
    return rows.filter(name <= F.element_at(upto, F.col("lang"))).groupBy("lang", name.alias("name")).agg(F.first("text").alias("text")).select("text", "lang")


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on all rows of ``df`` with a language and a letter. Document frequencies use every row; centroids use the sample.

    A null text or language, and a text without a letter, are left out; a text that many rows share is one row of the
    sample. A table without rows gives a model that knows no language.
    """
    rows = df.select(column(text_col).alias("text"), column(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, n = np.zeros(FEATURES, dtype=np.int64), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if LETTER.search(text):
                    times += gram_counts(text) > 0
                    n[lang] = n.get(lang, 0) + 1
        slots = np.flatnonzero(times)
        names = [None] * len(slots) + list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*slots, *[-1] * len(n)], pa.int32()), pa.array(names, pa.string()), pa.array([*times[slots], *n.values()], pa.int64())], ["slot", "lang", "n"]
        )

    # one row per slot and per language
    found = rows.mapInArrow(frequencies, "slot int, lang string, n long").groupBy("slot", "lang").agg(F.sum("n").alias("n")).collect()
    sizes = {r.lang: r.n for r in found if r.slot < 0}
    times = np.zeros(FEATURES)
    for r in found:
        if r.slot >= 0:
            times[r.slot] = r.n
    idf = (np.log((1 + sum(sizes.values())) / (1 + times)) + 1).astype(np.float32)
    if not sizes:
        return LanguageModel(idf, [], np.zeros((0, FEATURES), np.float32), np.zeros(0))

    sample = drawn(rows, sorted(sizes))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(lang, gram_counts(text)) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if LETTER.search(text)]
            if kept:
                slots = [np.flatnonzero(c) for _, c in kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in kept]), pa.array([s.astype("<u2").tobytes() for s in slots]), pa.array([c[s].astype("<u4").tobytes() for (_, c), s in zip(kept, slots)])],
                    ["lang", "slots", "counts"],
                )

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slots", "counts"])
        x = np.zeros((len(group), FEATURES), dtype=np.float32)
        for i, (slots, counts) in enumerate(zip(group["slots"], group["counts"])):
            x[i, np.frombuffer(slots, "<u2")] = np.log1p(np.frombuffer(counts, "<u4").astype(np.float32))
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, at = spherical_kmeans(x, CENTROIDS)
        near = np.einsum("ij,ij->i", x, c[at])
        rows = [(group["lang"].iloc[0], c[j].astype("<f4").tobytes(), float(np.quantile(near[at == j], OUTSIDE)) if (at == j).any() else 1.0) for j in range(len(c))]
        return pd.DataFrame(rows, columns=["lang", "centroid", "radius"])

    counted = sample.mapInArrow(sparse, "lang string, slots binary, counts binary")
    parts = counted.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, radius double").collect()  # a few rows per language
    parts.sort(key=lambda r: (r.lang, r.centroid))
    centroids = np.array([np.frombuffer(r.centroid, "<f4") for r in parts], dtype=np.float32).reshape(-1, FEATURES)
    return LanguageModel(idf, [r.lang for r in parts], centroids, np.array([r.radius for r in parts]))


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` from the text alone, one row for each input row.

    A text that is null or has no letter, and any text under a model with no training rows, is ``und`` with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rejected = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    ids = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return ids.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify_held_out(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all: ``doc_id, held_out, lang_pred, score, rejected``.

    One row for each input row, repeated and null ids too (a null id counts as the empty string in the split); whole
    texts of any length count. Null texts and texts without a letter are ``und``. An empty table gives an empty result.
    """
    model = fit(df.filter(~held_out(column(id_col))), text_col, lang_col)
    out = identify(df, model, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
