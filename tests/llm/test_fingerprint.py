"""Order MinHash against brute force, and successors against a sorted list."""

import hashlib

import numpy as np

from driftloom.llm import fingerprint as fp
from driftloom.llm.fingerprint import as_text, code_points, edit_likeness, fingerprint, fingerprints, kmer_hashes, likeness, numbered, smallest
from driftloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Rows (id, text) in descending order, each with its successor."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        a, b, c = (fingerprint(code_points(t)) for t in (text, edited, after))
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def test_query_equals_brute_force_on_its_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op10_fingerprints"](spark, SF)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs)


def test_edges(spark):
    texts = [None, "", "a", "ab", "x" * 5000, "ä😀" * 40, "one text", "one text"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "null id"), (-5, "below"), (10**12, "far")]
    schema = "doc_id long, text string"
    assert sorted((tuple(r) for r in edit_likeness(spark.createDataFrame(rows, schema)).collect()), key=str) == brute(rows)
    assert edit_likeness(spark.createDataFrame([], schema)).collect() == []
    assert edit_likeness(spark.createDataFrame([(1, "alone here")], schema)).first().near_next == 1.0
    equal = spark.createDataFrame([(7, "same", 1)] * 4, "doc_id long, text string, bucket int")
    assert {r.near_next for r in edit_likeness(equal).collect()} == {1.0}
    assert {r.fingerprint for r in fingerprints(equal).collect()} == {as_text(fingerprint(code_points("same")))}


def test_kmers_and_their_numbers():
    points = code_points("abcabcabcabc" * 3)
    h = kmer_hashes(points)
    assert len(h) == len(points) - fp.K + 1
    assert all((h[i] == h[j]) == (points[i : i + fp.K].tolist() == points[j : j + fp.K].tolist()) for i in range(len(h)) for j in range(len(h)))
    assert len(set(numbered(h).tolist())) == len(h)  # every occurrence is a k-mer of its own


def test_smallest_equals_a_full_sort(monkeypatch):
    x = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint32)
    want = np.sort(np.argsort(fp._ODD[:, None] * x + fp._ADD[:, None], axis=1, kind="stable")[:, :2], axis=1)
    assert (smallest(x, 2) == want).all()
    monkeypatch.setattr(fp, "STRETCH", 64)
    assert (smallest(x, 2) == want).all()


def test_likeness_falls_with_edits_and_with_order():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    text = " ".join(words)
    same = fingerprint(code_points(text))
    few, swapped = words.copy(), words[200:] + words[:200]
    for k in range(0, 400, 50):
        few[k] = "edited"
    near, moved = (likeness(same, fingerprint(code_points(" ".join(w)))) for w in (few, swapped))
    other = likeness(same, fingerprint(code_points(" ".join(reversed(words)))))
    assert near > 0.4 and 0.2 < moved < 0.9 and other < 0.1
