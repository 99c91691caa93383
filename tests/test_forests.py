"""Splits against all splits, large nodes, chunks of pieces, partitions, odd rows."""

import glob
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom.operators import forests
from driftloom.operators.forests import Forest, bag, best_cut, fit_forests, grow, importances, matrix, narrow, packed, predict_forests, route, unpacked

SCHEMA = "id long, label int, features array<double>"


def gini(y):
    _, n = np.unique(y, return_counts=True)
    return 1 - ((n / len(y)) ** 2).sum() if len(y) else 0.0


@pytest.mark.parametrize("seed", range(6))
def test_cut_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 6, (40, 3)).astype(float), rng.integers(0, 3, 40)
    gain, column, threshold = best_cut(x, np.eye(3)[y])
    drop = {(f, t): len(y) * gini(y) - sum(m.sum() * gini(y[m]) for m in (x[:, f] <= t, x[:, f] > t)) for f in range(3) for t in np.unique(x[:, f])[:-1]}
    assert gain == pytest.approx(max(drop.values()))
    side = x[:, column] <= threshold
    assert len(y) * gini(y) - side.sum() * gini(y[side]) - (~side).sum() * gini(y[~side]) == pytest.approx(gain)
    assert best_cut(np.ones((4, 2)), np.eye(2)[[0, 1, 0, 1]])[0] == -np.inf


def test_trees_grow_until_leaves_are_pure():
    rng = np.random.default_rng(0)
    x, y = rng.random((200, 5)), rng.integers(0, 4, 200)
    feature, threshold, child, shares, gain = grow(x, np.eye(4)[y], 30, 2, lambda _: rng.permutation(5))
    classes, f, c, t, s = unpacked(packed([0, 1, 2, 3], feature, threshold, child, shares))
    at = np.zeros(200, int)
    while (f[at] >= 0).any():
        at = np.where(f[at] >= 0, c[at] + (x[np.arange(200), f[at]] > t[at]), at)
    assert (classes[s[at].argmax(axis=1)] == y).all() and gain.min() >= 0
    assert len(grow(x, np.eye(4)[y], 1, 5, lambda _: rng.permutation(5))[0]) == 3


def test_bootstrap_draws_each_row_once_on_average():
    w = np.concatenate([bag(np.arange(20_000, dtype=np.uint64), t, 1) for t in range(5)])
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_route():
    x = np.array([[0.0, 5.0], [2.0, 5.0], [2.0, 1.0], [np.nan, 0.0]])
    assert route(x, {}).tolist() == [1] * 4 and route(x, {1: (0, 1.0), 3: (1, 1.0)}).tolist() == [2, 7, 6, 2]


def corners(n, seed=1):
    """Two classes at opposite corners, features that say nothing, and a rare third class."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 6)).round(3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    y[x[:, 2] > 0.97] = 7
    return [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))]


@pytest.mark.parametrize("large", [20_000, 100])
def test_large_nodes_are_split_level_by_level(spark, monkeypatch, large):
    monkeypatch.setattr(forests, "LEAF_ROWS", large)
    df = spark.createDataFrame(corners(1200), SCHEMA)
    forest = fit_forests(df.repartition(5), ["id"], trees=7)
    again = fit_forests(df.repartition(2), ["id"], trees=7)
    rows = lambda f: sorted(str((r.tree, r.node, r.feature, r.threshold, r.nodes)) for r in f.table.collect())
    assert rows(forest) == rows(again)
    splits, pieces = forest.table.where("feature is not null").count(), forest.table.where("feature is null").count()
    assert (splits == 0) == (large > 1200) and pieces == splits + 7
    assert (predict_forests(df, forest).where("pred = label").count()) > 1150
    fresh = spark.createDataFrame(corners(600, 2), SCHEMA)
    assert predict_forests(fresh, forest).where("pred = label").count() > 540
    top = importances(forest).orderBy(F.desc("importance")).collect()
    assert {r.feature for r in top[:2]} == {0, 1} and sum(r.importance for r in top) == pytest.approx(1)


def test_pure_and_constant_large_nodes_become_leaves(spark, monkeypatch):
    monkeypatch.setattr(forests, "LEAF_ROWS", 20)
    rows = [(i, int(i % 2), [1.0, 1.0]) for i in range(100)] + [(100 + i, 5, [float(i), 2.0]) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = predict_forests(df, fit_forests(df, ["id"], trees=9, mtry=1)).groupBy("label", "pred").count().collect()
    assert {(r.label, r.pred) for r in out if r.label == 5} == {(5, 5)} and all(r.pred in (0, 1) for r in out if r.label < 5)


def test_models_are_rows_and_chunks_change_nothing(spark, monkeypatch):
    """One forest per key, each equal to the one fitted alone; chunks of pieces and small blocks give the same classes."""
    df = spark.createDataFrame([(i, c, v, f"m{i % 3}") for i, c, v in corners(300)], SCHEMA + ", key string")
    both = fit_forests(df, ["id"], trees=6, model="key")
    want = {r.id: r.pred for r in predict_forests(df, both, model="key").collect()}
    alone = fit_forests(df.where("key = 'm1'"), ["id"], trees=6)
    assert all(want[r.id] == r.pred for r in predict_forests(df.where("key = 'm1'"), alone).collect())
    monkeypatch.setattr(forests, "CHUNK", 2000)
    assert {r.id: r.pred for r in predict_forests(df, both, model="key").collect()} == want
    swapped = df.withColumn("key", F.when(F.col("key") == "m0", "none").otherwise(F.col("key")))
    assert {r.id for r in predict_forests(swapped, both, model="key").where("pred is null").collect()} == {i for i in range(300) if i % 3 == 0}


def test_odd_rows(spark, folder):
    rows = [(i, i % 2, [float(i % 2), 0.0]) for i in range(40)] + [(50, None, [1.0, 1.0]), (51, 1, None), (52, 1, [None, 1.0]), (53, 1, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    forest = fit_forests(df, ["id"], trees=5)
    forest.save(folder)
    odd = spark.createDataFrame([(1, 0, None), (2, 0, [1.0]), (3, 0, [None, 1.0]), (4, 0, [1.0, 0.0])], SCHEMA)
    assert {r.id: r.pred for r in predict_forests(odd, Forest.load(folder)).collect()} == {1: None, 2: None, 3: 0, 4: 1}
    assert predict_forests(odd.limit(0), forest).collect() == []
    with pytest.raises(ValueError):
        fit_forests(df.limit(0), ["id"])
    with pytest.raises(ValueError):
        fit_forests(odd.where("id in (2, 4)"), ["id"])


def test_a_row_asks_no_more_chunks_than_trees(spark, monkeypatch):
    """Forests with far more chunks than trees: the same classes, and a pair a row and tree at most."""
    monkeypatch.setattr(forests, "LEAF_ROWS", 40)
    df = spark.createDataFrame([(i, c, v, f"m{i % 2}") for i, c, v in corners(600)], SCHEMA + ", key string")
    forest = fit_forests(df, ["id"], trees=3, model="key")
    want = {r.id: r.pred for r in predict_forests(df, forest, model="key").collect()}
    pairs, plain = [], forests.apply_models
    monkeypatch.setattr(forests, "apply_models", lambda rows, *rest, **more: pairs.append(rows.count()) or plain(rows, *rest, **more))
    monkeypatch.setattr(forests, "CHUNK", 300)
    assert {r.id: r.pred for r in predict_forests(df, forest, model="key").collect()} == want
    assert 600 < pairs[0] <= 600 * 3  # a pair a row and chunk when every row asked every chunk


def test_nodes_take_little_room():
    rng = np.random.default_rng(0)
    x, y = rng.random((500, 5)), rng.integers(0, 10, 500)
    *nodes, _ = grow(x, np.eye(10)[y], 30, 2, lambda _: rng.permutation(5))
    assert len(packed(range(10), *nodes)) < 18 * len(nodes[0]) + 500  # 56 bytes a node when each had its ten shares


def test_small_trees_are_dealt_to_many_tasks(spark):
    forest = fit_forests(spark.createDataFrame(corners(300), SCHEMA), ["id"], trees=40)
    assert len(forest.table.inputFiles()) > 12  # a handful when Spark put partitions together by their bytes


@pytest.mark.parametrize("seed", range(4))
def test_weighted_cut_is_the_same_as_by_counting(seed):
    rng = np.random.default_rng(seed)
    for n in (2, 3, 9, 60):
        x, y, w = rng.integers(0, 4, (n, 3)).astype(float), rng.integers(0, 3, n), rng.integers(1, 4, n)
        gain, column, threshold = best_cut(x, np.eye(3)[y] * w[:, None])
        y, z = np.repeat(y, w), np.repeat(x, w, axis=0)
        drop = [len(y) * gini(y) - sum(m.sum() * gini(y[m]) for m in (z[:, f] <= t, z[:, f] > t)) for f in range(3) for t in np.unique(x[:, f])[:-1]]
        if len(np.unique(y)) > 1 and drop:
            assert gain == pytest.approx(max(drop))


def test_counts_leave_a_task_in_small_pieces(spark, monkeypatch):
    """Counts that are handed on early give the same splits, and a task holds few of them."""
    monkeypatch.setattr(forests, "LEAF_ROWS", 60)
    df = spark.createDataFrame(corners(200), SCHEMA).coalesce(1)
    rows = lambda f: sorted(str((r.tree, r.node, r.feature, r.threshold)) for r in f.table.collect())
    assert forests.HELD <= 32 << 20  # 128 before, and twice more while they were handed on
    want = rows(fit_forests(df, ["id"], trees=2, depth=4))
    monkeypatch.setattr(forests, "HELD", 1 << 10)
    assert rows(fit_forests(df, ["id"], trees=2, depth=4)) == want


def test_vectors_travel_in_four_bytes_a_number_where_that_loses_nothing():
    for rows, size in (([[0.5, -2.0], [1e30, float("nan")], [float("inf"), None]], 8), ([[0.5, 0.1]], 16), ([[1e300, 0.0]], 16)):
        if size == 8:
            rows[1][0] = float(np.float32(1e30))
        column = pa.array([[9.0, 9.0], *rows], pa.list_(pa.float64())).slice(1)
        got = narrow(column).to_pylist()
        assert [len(v) for v in got] == [size] * len(rows)
        assert np.array_equal(matrix(got, 2), np.array(rows, float), equal_nan=True)
    both = [*narrow(pa.array([[0.1, 3.0]])).to_pylist(), *narrow(pa.array([[0.5, 4.0]])).to_pylist()]
    assert matrix(both, 2).tolist() == [[0.1, 3.0], [0.5, 4.0]] and matrix([], 2).shape == (0, 2)


def test_rows_travel_a_few_trees_at_a_time_and_leave_no_shuffle_files(spark, monkeypatch):
    """Six waves of a tree give the forest of one, and the copies of the rows are gone from the disks afterwards."""
    monkeypatch.setattr(forests, "LEAF_ROWS", 60)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.createDataFrame([(i, c, v, f"m{i % 2}") for i, c, v in corners(400)], SCHEMA + ", key string")
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    rows = lambda f: sorted(str((r.key, r.tree, r.node, r.feature, r.threshold, r.nodes)) for r in f.table.collect())
    old, conf, jobs, plain = files(), spark.conf.get(key), [], forests.settle_in_turn
    monkeypatch.setattr(forests, "settle_in_turn", lambda frames: plain(jobs.append(1) or f for f in frames))
    want = rows(fit_forests(df, ["id"], trees=6, model="key"))
    monkeypatch.setattr(forests, "WAVE", 1)
    assert rows(fit_forests(df, ["id"], trees=6, model="key")) == want and len(jobs) == 2 + 7  # the large splits are one more
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old and spark.conf.get(key) == conf
