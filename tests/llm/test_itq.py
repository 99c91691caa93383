"""All pairs in numpy: links, recall at the threshold, components; codes and tables; odd rows."""

from collections import defaultdict

import numpy as np
import pytest

from driftloom.llm import itq
from driftloom.llm.itq import Tables, fit, folded, near_embeddings, smallest_reachable, tables
from driftloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=0.98):
    """n_links and component of each row by all pairs."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    unit = [np.array(v, float) / np.abs(v).max() if ok else None for (_, v, _), ok in zip(rows, good)]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    links = [[j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            todo, comp = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in comp:
                        comp.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in comp if rows[j][0] is not None]
            seen |= dict.fromkeys(comp, min(ids, default=None))
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return out


def near(rng, v, cosine):
    away = rng.standard_normal(len(v))
    away -= away @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def planted(seed, groups, size, low=0.9805, d=64, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        v = rng.standard_normal(d) + shift
        rows += [v.tolist(), *(near(rng, v, rng.uniform(low, 0.995)).tolist() for _ in range(size - 1))]
    return [(i, v, 1) for i, v in enumerate(rows)]


@pytest.mark.parametrize("shift, d", [(0.0, 64), (0.0, 9), (2.0, 64), (0.0, 300)])
def test_links_at_the_threshold_are_found(spark, shift, d):
    rows = planted(3, 400, 2, 0.98 + 1e-9, d, shift)
    out = near_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = {r[0]: r for r in brute(rows)}
    assert len(out) == len(rows) and all(r.n_links <= want[r.vec_id][1] for r in out)
    assert sum(r.n_links for r in out) >= 0.99 * sum(r[1] for r in want.values())


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, QUERIES["op13_near_embeddings"](spark, sf).collect())) == sorted(brute(rows))


def test_groups_in_small_cells_and_blocks(spark, monkeypatch):
    """One large group of near copies that are all linked, chains, and copies: cut cells and blocks count each pair once."""
    monkeypatch.setattr(itq, "CELL", 8)
    monkeypatch.setattr(itq, "BLOCK", 4)
    monkeypatch.setattr(itq, "PAIRS", 50)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(i, near(rng, centre, 0.999).tolist(), 1) for i in range(60)]
    chain = [np.cos(0.15 * i) * np.eye(16)[0] + np.sin(0.15 * i) * np.eye(16)[1] for i in range(9)]
    rows += [(100 - i, v.tolist(), 1) for i, v in enumerate(chain)] + [(200 + i, centre.tolist(), i % 2) for i in range(40)]
    out = near_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [1.0, None, 3.0], 1), (5, [float("nan"), 2.0, 3.0], 1), (6, [float("inf"), 2.0, 3.0], 1), (7, one, None), (8, one, None)]
    rows += [(9, one, 1), (9, one, 1), (9, [3.0, -1.0, 0.0], 1), (None, one, 1), (12, [2.0, 4.0, 6.0], 1), (13, [*one, 0.0], 1), (14, one, 2), (None, [-1.0, 0.0, 5.0], 3), (None, [-1.0, 0.0, 5.0], 3), (15, [1e300, 2e300, 3e300], 1), (16, [1e-300, 2e-300, 3e-300], 1)]
    df = spark.createDataFrame([(*r, 1, "a", True) for r in rows], SCHEMA + ", node int, digest string, kept boolean")
    assert sorted(map(str, map(tuple, near_embeddings(df).collect()))) == sorted(map(str, brute(rows)))
    assert [tuple(r) for r in near_embeddings(df.filter("vec_id = 1")).collect()] == [(1, 0, 1, True)]
    empty = near_embeddings(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("radius", [1, 5, 11, 20, 40, 64])
@pytest.mark.parametrize("n", [10, 10_000, 10_000_000])
def test_tables_meet_within_the_radius(radius, n):
    """Every pair of codes within the radius meets first in exactly one table, whatever the cut."""
    index = tables(radius, n)
    rng = np.random.default_rng(radius)
    apart = np.array([sum(1 << int(i) for i in rng.choice(64, rng.integers(0, radius + 1), replace=False)) for _ in range(500)], np.uint64)
    assert sum(index.width) == 64
    assert (sum(index.first(t, apart).astype(int) for t in range(len(index.shift))) == 1).all()


def test_masks_are_the_keys_that_near():
    index = Tables([0, 5], [5, 6], [2, 1])
    assert sorted(index.masks(0)) == [m for m in range(32) if m.bit_count() <= 2] and index.masks(0)[0] == 0
    assert sorted(index.masks(1)) == [0, 1, 2, 4, 8, 16, 32]


def test_learned_rotation_loses_less_than_it_started_with_and_bits_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)) * np.linspace(0.2, 2, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    loss = lambda m: np.abs(np.abs(x @ m.directions - m.offset) - np.abs(x @ m.directions - m.offset).mean()).mean()
    after, rounds = fit(x, 64, 0.98), itq.ROUNDS
    itq.ROUNDS = 0
    try:
        before = fit(x, 64, 0.98)
    finally:
        itq.ROUNDS = rounds
    assert loss(after) < loss(before)
    share = (x @ after.directions > after.offset).mean(axis=0)
    assert abs(share - 0.5).max() < 0.1 and 5 < after.radius < 20


def test_folding_keeps_short_vectors():
    x = np.arange(6.0).reshape(2, 3)
    assert folded(x, 4).tolist() == [[0, 1, 2, 0], [3, 4, 5, 0]] and folded(x, 2).shape == (2, 2)


def test_smallest_reachable():
    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    parent = defaultdict(set)
    for a, b in zip(u, v):
        comp = {a, b} | parent[a] | parent[b]
        for c in comp:
            parent[c] = comp
    node, least = smallest_reachable(u, v)
    assert {n: s for n, s in zip(node, least)} == {n: min(c) for n, c in parent.items()}
