"""Components against brute force, sketches against their formulas, edge cases and hot groups."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftloom.llm import neardup
from driftloom.llm.components import connect
from driftloom.llm.neardup import BANDS, band_keys, likely_similarity, near_duplicates, registers, shingles
from driftloom.llm.queries import QUERIES
from driftloom.llm.text import WordHashes

SF = "/root/testdata/sf0.01"


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent=80):
    """(id, set size, component, kept) by comparing all documents that share a shingle."""
    sets = {d: word_set(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            by[s].append(d)
    for d in sets:
        common = defaultdict(int)
        for s in sets[d]:
            for e in by[s]:
                if e < d:
                    common[e] += 1
        for e, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d, _ in rows)


def test_query_equals_brute_force_on_its_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = sorted(tuple(r) for r in QUERIES["op8_near_duplicates"](spark, SF).collect())
    assert out == brute(rows, 2) and sum(not r[3] for r in out) > 50


@pytest.mark.parametrize("k", [2, 5])
def test_groups_of_near_copies(spark, k):
    """A hot group of near copies of one text, chains at the threshold, and texts that only share a passage."""
    rng = random.Random(k)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    base, passage = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(150):
        words = base.copy()
        for at in rng.sample(range(120), rng.randint(0, 9)):
            words[at] = rng.choice(vocabulary)
        texts.append(words)
    texts += [rng.choices(vocabulary, k=40) + passage + rng.choices(vocabulary, k=20) for _ in range(60)]
    chain = rng.choices(vocabulary, k=100)
    for _ in range(20):
        chain = [rng.choice(vocabulary) if i == rng.randint(0, 99) else w for i, w in enumerate(chain)][3:] + rng.choices(vocabulary, k=2)
        texts.append(chain)
    rows = [(i * 7 % 100_003, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=k).collect()
    assert sorted(tuple(r) for r in out) == brute(rows, k)


def test_edges(spark):
    schema = "doc_id long, text string, node long, kept string"
    long = "alpha beta gamma " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "WORD"), (6, "Word other"), (7, long), (8, long + "end"), (9, "é É"), (10, "é é")]
    out = near_duplicates(spark.createDataFrame([(*r, 0, "x") for r in rows], schema), words=2).collect()
    assert sorted(tuple(r) for r in out) == brute(rows, 2)
    odd = spark.createDataFrame([(None, "alone here"), (None, "a b"), (3, "a b"), (3, "a b"), (3, "x y z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(odd, words=2).collect()) == [
        ("3", "3", True), ("3", "3", True), ("3", "3", True), ("None", "3", False), ("None", "None", True)
    ]
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().kept


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    parent = {x: x for p in links for x in p}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.node: r.label for r in connect(spark.createDataFrame(links, "a long, b long")).collect()} == parent
    assert connect(spark.createDataFrame([], "a long, b long")).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    assert (registers(h) == np.maximum(registers(h[:2500]), registers(h[2500:]))).all()
    for overlap in (0.0, 0.5, 0.8, 1.0):
        n = int(1000 * overlap)
        pairs = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2000 - n).astype(np.uint64)
            pairs.append((registers(x[:1000]), registers(x[1000 - n :])))
        a, b = (np.array(side) for side in zip(*pairs))
        size = np.full(40, 1000.0)
        true = n / (2000 - n)
        assert abs(likely_similarity(a, b, size, size).mean() - true) < 0.03
    assert len(band_keys(a[0])) == BANDS


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    found = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        found += (band_keys(registers(x[:900])) == band_keys(registers(x[100:]))).any()  # 800 of 1000
    assert found == 300


def test_short_texts_are_one_shingle():
    hashes = WordHashes()
    one, pair = shingles([b"a"], 5, hashes), shingles([b"a", b"b"], 5, hashes)
    assert len(one) == len(pair) == 1 and one[0] != pair[0] and len(shingles([], 5, hashes)) == 0
    assert neardup.shingles([b"a", b"b", b"a", b"b"], 2, hashes).size == 2


def test_blocks_change_nothing(spark, monkeypatch):
    """Texts that are nearly but not all linked with each other, with buckets cut into small blocks."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(2000)]
    base = rng.choices(vocabulary, k=100)
    rows = []
    for i in range(120):
        words = base.copy()
        for at in rng.sample(range(100), rng.randint(4, 8)):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    want = brute(rows, 2)
    assert len({r[2] for r in want}) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (2048, 16):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert sorted(tuple(r) for r in near_duplicates(df, words=2).collect()) == want


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for n in (5, 50, 500, 5000):
        x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = x[: 9 * n // 5], x[n // 5 :]  # 8/5 of 2
        bits = [np.frombuffer(neardup.bitmap(s), "<u8")[None] for s in (a, b)]
        size = [np.array([len(s)]) for s in (a, b)]
        assert neardup.possible(*size, *bits, percent=80)[0]


def test_groups_are_bounded_where_all_nodes_ask(spark, monkeypatch):
    """One bucket of 300 unlinked nodes: no group holds more than about two cells, and all pairs that may be linked meet."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    size = {i: 80 if i % 3 else 100 if i % 2 else 300 for i in range(300)}
    named = spark.createDataFrame([(5, i, i if i < 290 else 290) for i in range(300)], "key long, node long, label long")
    known = spark.createDataFrame([(i, n, b"", b"") for i, n in size.items()], "node long, n long, sketch binary, bitmap binary")
    groups = defaultdict(list)
    for r in neardup.in_groups(named, known, 80).collect():
        groups[r.key, r.part].append(r)
    assert max(map(len, groups.values())) <= 64
    met = Counter(tuple(sorted((q.node, r.node))) for g in groups.values() for q in g if q.asks for r in g if r.lives and q.label != r.label)
    label = lambda i: min(i, 290)
    pairs = {(a, b) for a in size for b in size if a < b and label(a) != label(b)}
    assert {(a, b) for a, b in pairs if 80 * max(size[a], size[b]) <= 100 * min(size[a], size[b])} <= set(met) <= pairs
    assert not any({size[a], size[b]} == {80, 300} for a, b in met)


def test_true_miss_rate_at_the_threshold():
    """Three in ten million, counted with the registers that bands share; a smaller case agrees with the picks."""
    assert neardup.missed(0.8) < 3e-7
    rng = np.random.default_rng(8)
    equal = rng.random((20_000, neardup.REGISTERS)) < 0.5
    share = np.mean([not e[neardup._PICK].all(axis=1).any() for e in equal])
    assert abs(share - neardup.missed(0.5)) < 0.05


def test_clashing_columns_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 5, 6), (2, text, "b", 5, 6), (3, "something else altogether", "c", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, GONE_ID_0 int, digest int")
    out = neardup.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
