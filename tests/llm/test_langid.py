"""Held-out accuracy, folds, rejection and edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import langid
from driftloom.llm.langid import CENTROIDS, FEATURES, fit, gram_counts, identify, identify_held_out, spherical_kmeans
from driftloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = QUERIES["op4_language_id"](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def grams(text):
    """Bigrams and trigrams of bytes, hashed one by one."""
    raw = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in f" {text.lower()} ".encode())
    out = Counter()
    for n in (2, 3):
        for i in range(len(raw) - n + 1):
            value = int.from_bytes(raw[i : i + n], "big") | ((1 << 30) if n == 3 else 0)
            out[(value * 2654435761 & 0xFFFFFFFF) >> (32 - 13)] += 1
    return out


def tfidf(text, idf):
    v = np.zeros(FEATURES)
    for slot, n in grams(text).items():
        v[slot] = math.log1p(n) * idf[slot]
    return v / np.linalg.norm(v)


def test_model_and_answers_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(160)
    rows = [(r.text, r.lang) for r in docs.collect() if r.text and r.lang and any(c.isalpha() for c in r.text)]
    model = fit(docs.repartition(5))
    frequency = Counter(slot for text, _ in rows for slot in grams(text))
    idf = np.array([math.log((1 + len(rows)) / (1 + frequency[s])) + 1 for s in range(FEATURES)])
    assert np.allclose(model.idf, idf, atol=1e-5)
    for lang in {lang for _, lang in rows}:
        own = np.array([tfidf(t, idf) for t in {t for t, own in rows if own == lang}])
        centre = model.centroids[[i for i, name in enumerate(model.languages) if name == lang]]
        at = (own @ centre.T).argmax(axis=1)
        for j in set(at):  # each centroid is the direction of the texts that are nearest to it
            mean = own[at == j].sum(axis=0)
            assert centre[j] @ mean / np.linalg.norm(mean) > 0.999
    for r, (text, _) in zip(identify(spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(1)), model).collect(), rows):
        cosine = model.centroids @ tfidf(text, idf)
        assert abs(r.score - min(max(cosine.max(), 0), 1)) < 1e-4
        assert cosine.max() - cosine[[i for i, name in enumerate(model.languages) if name == r.lang_pred]].max() < 1e-4


def test_copies_of_a_text_are_one_row_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PER_LANGUAGE", 30)
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 'one page in very many copies', concat('page ', id % 500)) AS text", "if(id % 7 = 0, 'xx', 'yy') AS lang")
    got = langid.drawn(rows, ["xx", "yy"]).collect()
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    for lang in ("xx", "yy"):
        texts = {r.text for r in rows.collect() if r.lang == lang}
        assert sorted(r.text for r in got if r.lang == lang) == sorted(sorted(texts, key=digest)[:30])


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = fit(docs)
    assert len(model.languages) <= CENTROIDS * len(set(model.languages))
    schema = "doc_id long, text string, score string"
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !? 4", "x"), (None, "the and that", "x"), (5, "the " * 50_000, "x"), (5, "the " * 50_000, "x"), (6, "漢字仮名交じり文", "x")]
    out = {(r.doc_id, r.lang_pred): r for r in identify(spark.createDataFrame(rows, schema), model).collect()}
    assert all((k, "und") in out and out[(k, "und")].score == 0 for k in (1, 2, 3))
    assert (None, "en") in out and (5, "en") in out
    assert next(r for r in out.values() if r.doc_id == 6).rejected
    assert identify(spark.createDataFrame([], schema), model).collect() == []


def test_no_training_rows(spark):
    rows = [(1, "some text", None), (2, None, "en"), (3, "12", "en")]
    out = identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} == {"und"}


def test_grams_and_centroids():
    counts = gram_counts("Ab ab!")
    assert counts.sum() == 2 * (len(" ab ab  ") - 1) - 1 and len(counts) == FEATURES
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.05, (50, 8)) for m in np.eye(8)[:3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = spherical_kmeans(x, 3)[1]
    assert all(len(set(at[k : k + 50])) == 1 for k in (0, 50, 100)) and len(set(at)) == 3
