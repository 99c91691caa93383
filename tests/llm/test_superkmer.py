"""Repeated word windows against brute force, super-k-mers and cuts of hot minimisers."""

import hashlib
import random
import re

import numpy as np
import pytest

from driftloom.llm import repeats, superkmer
from driftloom.llm.queries import QUERIES
from driftloom.llm.superkmer import WINDOW, pieces_of, remove_repeats
from driftloom.llm.text import WordHashes

SF = "/root/testdata/sf0.01"


def brute(rows):
    first, out = {}, []
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in sorted(rows)]
    for d, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            if first.setdefault(tuple(words[i : i + WINDOW]), (d, i)) != (d, i):
                gone[i : i + WINDOW] = [True] * WINDOW
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_equals_brute_force_on_its_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = sorted(tuple(r) for r in QUERIES["op6_repeated_windows"](spark, SF).collect())
    want = brute(rows)
    assert out == want and sum(r[2] > 0 for r in want) > 50


@pytest.mark.parametrize("most", [1000, 3])
def test_passages_in_many_surroundings(spark, monkeypatch, most):
    """With a small bucket bound every shared minimiser is dealt anew."""
    monkeypatch.setattr(repeats, "BUCKET", most)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(300)]
    passage = rng.choices(vocabulary, k=45)
    texts = []
    for i in range(60):
        cut = passage[rng.randint(0, 10) : rng.randint(28, 45)]
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)) + cut + rng.choices(vocabulary, k=rng.randint(0, 40))))
    texts += ["x " * 70, "x y " * 50, "p q r s t " * 12, "x " * 30]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("kept_text").collect()
    assert sorted(tuple(r) for r in out) == brute(rows)


def test_edges(spark):
    long = " ".join(str(i) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b"), (5, long), (4, long), (6, "é " * 25), (7, "z\x0b" * 19)]
    schema = "doc_id long, text string, key string, spans string"
    out = remove_repeats(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).drop("kept_text").collect()
    assert sorted(tuple(r) for r in out) == brute([(d, t) for d, t in rows])
    same = remove_repeats(spark.createDataFrame([(9, long), (9, long), (None, long), (None, long)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in same) == [("9", 0), ("9", 0), ("None", 30_000), ("None", 30_000)]
    assert remove_repeats(spark.createDataFrame([], schema)).collect() == []


def test_pieces_cover_every_window_once():
    rng = random.Random(2)
    length = np.array([0, 19, 20, 21, 3, 400, 0])
    w = WordHashes().of([rng.choice([b"a", b"b", b"c"]) for _ in range(length.sum())])
    key, digest, text, start, windows, at = pieces_of(w, length)
    seen = [(t, j) for t, s, c in zip(text, start, windows) for j in range(s, s + c)]
    assert seen == [(t, j) for t, n in enumerate(length) for j in range(max(n - WINDOW + 1, 0))]
    assert ((at >= windows - 1) & (at <= WINDOW - 4)).all() and len(key) == len(digest)
    w = np.arange(100, dtype=np.uint64)
    one, two = pieces_of(w, np.array([100])), pieces_of(np.concatenate([w[50:], w]), np.array([150]))
    assert set(zip(one[0][5:-5], one[1][5:-5])) <= set(zip(two[0], two[1]))
    assert all(len(c) == 0 for c in pieces_of(w[:2], np.array([2])))


def test_texts_longer_than_a_stretch_are_cut(spark, monkeypatch):
    """Places have 8 bits here: a text of 3,000 words fits only in stretches."""
    monkeypatch.setattr(repeats, "PLACE_BITS", 8)
    monkeypatch.setattr(superkmer, "STRETCH", 64)
    rng = random.Random(9)
    words = [str(rng.randrange(10_000)) for _ in range(3_000)]
    words[2_500:2_600] = words[40:140]
    rows = [(1, " ".join(words)), (2, " ".join(["a", *words[1_000:1_300], "b"])), (3, " ".join(words[1_290:1_310])), (4, "x y " * 200), (5, "short")]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept_text").collect()
    assert sorted(tuple(r) for r in out) == brute(rows)
    with pytest.raises(ValueError, match="units at once"):
        pieces_of(np.arange(257, dtype=np.uint64), np.array([257]))
