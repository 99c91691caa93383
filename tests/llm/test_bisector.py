"""Lloyd rounds in Python integers, the SQL twin, ties, empty clusters, odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from driftloom.llm.bisector import SEED, Tournament, clustered, largest
from driftloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


def lloyd(rows, k=8, rounds=10, scale=1024, dimensions=64):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{SEED}:{r[0]}".encode()).hexdigest(), r[1])
    centre = [v for _, v in sorted(kept, key=name)[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centre)), key=lambda c: (gap(v, centre[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        groups = [[v for (_, v), c in zip(kept, own) if c == j] for j in range(len(centre))]
        centre = [[sum(x) // len(g) for x in zip(*g)] if g else centre[j] for j, g in enumerate(groups)]
    own = [(i, near(v), gap(v, centre[near(v)])) for i, v in kept]
    digest = lambda c: hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()
    return [(i, c, d, sum(e for _, o, e in own if o == c), sum(e for *_, e in own), digest(c)) for i, c, d in own]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    out = QUERIES["op11_bisector_clusters"](spark, SF)
    want = con.execute(SQL["op11_bisector_clusters"])
    assert out.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force_with_many_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, [rng.randrange(-2, 3) / 1024 for _ in range(3)]) for _ in range(90)]
    out = clustered(spark.createDataFrame(rows, SCHEMA).repartition(5), dimensions=3, clusters=6).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, lloyd(rows, 6, dimensions=3)))


def test_signs_find_the_nearest_at_the_largest_integers():
    top = largest(64)
    rng = np.random.default_rng(5)
    for centre in (rng.integers(-3, 4, (9, 64)), rng.choice([-top, top], (9, 64))):
        x = np.concatenate([rng.integers(-3, 4, (50, 64)), rng.choice([-top, top], (50, 64)), centre])
        t = Tournament(centre.tolist())
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centre] for v in x]
        assert t.winners(x).tolist() == [d.index(min(d)) for d in exact]
        assert t.distances(x, t.winners(x)).tolist() == [min(d) for d in exact]


def test_odd_rows(spark):
    schema = SCHEMA + ", cluster string, x int, distance int"
    good = [(i, [float(i % 5), 0.5]) for i in range(30)]
    odd = [(50, None), (51, []), (52, [1.0]), (53, [None, 1.0]), (54, [float("nan"), 1.0]), (55, [float("-inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    rows = [(*r, "a", 1, 2) for r in good + odd]
    out = clustered(spark.createDataFrame(rows, schema), dimensions=2).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, lloyd(good + odd, dimensions=2)))
    few = clustered(spark.createDataFrame(rows[:3], schema), dimensions=2).collect()
    assert {r.distance for r in few} == {0} and len({r.cluster for r in few}) == 3
    assert clustered(spark.createDataFrame([(1, [1e300, -1e300])], SCHEMA), dimensions=2).collect()[0].distance == 0
    empty = clustered(spark.createDataFrame([], schema), dimensions=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
