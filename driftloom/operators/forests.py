"""Random forests whose nodes are rows: grown on the executors for any number of models at once, stored and scored as a table.

A bootstrap weight is a hash of row and tree, so no sample is stored. Nodes of more than ``LEAF_ROWS`` rows are split level by
level: a pass over the rows adds up class counts per bin of the node's random features, the partial counts meet per node,
and one split a large node is all that the driver learns. As soon as a node's rows fit a task they travel to it
and the rest of the tree below is grown there, on exact thresholds, until leaves are pure. A forest is a table with
a row per such piece and per large split. Scoring joins pieces to blocks of rows by a model key, so one pass scores any
number of pairs of model and rows, and a forest too large for a task is scored chunk by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.names import q
from driftloom.session import dropped_shuffles, settle, settle_in_turn

#: Spark's largest depth of a tree, and ours.
DEEPEST = 30
#: Rows that a task grows a subtree from; bins of a feature in larger nodes; rows and bytes of models scored in one go.
LEAF_ROWS, BINS, BLOCK_ROWS, CHUNK = 20_000, 32, 50_000, 32 << 20
#: The bins' edges are quantiles of a sample: rows with the smallest hashes, at most so many and of so many numbers.
EDGE_ROWS, EDGE_NUMBERS = 10_000, 2_000_000
#: Tasks, at most, that the pieces of all models are dealt to.
TASKS = 2_000
#: Bytes of counts that a task holds before it hands them on.
HELD = 32 << 20
#: Bytes of rows, about, that travel to their pieces at once, but a tree of each model at least.
WAVE = 2 << 30

_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
Splits = dict[int, tuple[int, float]]
#: How often each row, by its hash, is in a tree's sample.
Draw = Callable[[np.ndarray, int], np.ndarray]


@dataclass
class Forest:
    """``table``: model, tree, node, feature and threshold (large splits), nodes (pieces), gain (per feature). ``model`` is the key's name."""

    table: DataFrame
    model: str = "model"

    def save(self, path: str) -> None:
        self.table.withColumnRenamed(self.model, "model").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str, model: str = "model") -> Forest:
        return Forest(SparkSession.active().read.parquet(path).withColumnRenamed("model", model), model)


# ---------------------------------------------------------------- inside a task


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of ``x`` (uint64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (by its hash) is in the tree's bootstrap sample: Poisson with mean 1."""
    u = (mixed(mixed(h, seed), tree) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_CDF, u, "right")


def route(x: np.ndarray, splits: Splits) -> np.ndarray:
    """The node each row reaches; the children of node n are 2 n and 2 n + 1, up to the threshold goes to the first."""
    out, todo = np.ones(len(x), np.int64), [(1, np.arange(len(x)))] if 1 in splits else []
    while todo:
        node, rows = todo.pop()
        feature, threshold = splits[node]
        right = x[rows, feature] > threshold
        for child, part in ((2 * node, rows[~right]), (2 * node + 1, rows[right])):
            out[part] = child
            if child in splits and len(part):
                todo.append((child, part))
    return out


def chosen(d: int, mtry: int, seed: int, tree: int, node: int) -> np.ndarray:
    """Features in a node's random order; the first ``mtry`` are looked at first."""
    return np.random.default_rng([seed & 0xFFFFFFFF, tree, node]).permutation(d)


def best_cut(x: np.ndarray, counts: np.ndarray) -> tuple[float, int, float]:
    """Gain, column and threshold of the split with the purest sides (Gini); gain -inf if no column has two values.

    A row counts for one class.
    """
    return _cut(np.ascontiguousarray(x.T), counts.argmax(axis=1), counts.sum(axis=1), counts.sum(axis=0))


def _cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, total: np.ndarray) -> tuple[float, int, float]:
    """The same from features as rows, with a class and a weight for each row.

    The sums of the classes' squares on both sides of a place follow from the place before, so a node takes a few numbers
    a row and column, whatever the number of classes. All of them are whole numbers, so nothing is rounded.
    """
    n, squares = len(w), total.dot(total)
    whole = total.sum()
    if n == 2:  # two rows of two classes: the first column that tells them apart
        apart = (x[:, 0] != x[:, 1]).tolist()
        if True not in apart:
            return -np.inf, 0, 0.0
        column = apart.index(True)
        low, high = sorted(x[column].tolist())
        middle = low + (high - low) / 2
        return float(whole - squares / whole), column, middle if low <= middle < high else low
    row = np.arange(0, n * len(x), n)[:, None]
    order = x.argsort(axis=1)
    value = x.take(order + row)
    ys, ws = y.take(order), w.take(order)
    by_class = ys.argsort(axis=1, kind="stable")
    by_class += row
    seen = np.empty(n * len(x))  # weight of the row's own class up to the row
    seen[by_class] = ws.take(by_class).cumsum(axis=1)
    left = (ws * (2 * (seen.reshape(ws.shape) - (total.cumsum() - total).take(ys)) - ws)).cumsum(axis=1)[:, :-1]
    right = left + (squares - (ws * (2 * total).take(ys)).cumsum(axis=1)[:, :-1])
    size = ws.cumsum(axis=1)[:, :-1]
    score = left / size + right / (whole - size)
    score[value[:, 1:] <= value[:, :-1]] = -np.inf
    at, column = divmod(int(score.T.argmax()), len(x))
    best = float(score[column, at])
    if best == -np.inf:
        return best, 0, 0.0
    low, high = float(value[column, at]), float(value[column, at + 1])
    middle = low + (high - low) / 2
    return float(best - squares / whole), column, middle if low <= middle < high else low


def grow(x: np.ndarray, counts: np.ndarray, depth: int, mtry: int, order: Callable[[int], np.ndarray]) -> tuple[list, list, list, np.ndarray, np.ndarray]:
    """A tree on rows ``x`` with weighted class ``counts`` (one class a row): feature (-1: leaf), threshold, first child, class shares, gain per feature.

    Every node looks at ``mtry`` features, and at others only if none of these has two values.
    """
    classes = counts.shape[1]
    columns, w = np.ascontiguousarray(x.T), counts.sum(axis=1)
    flat = columns.ravel()
    y = counts.argmax(axis=1).astype(np.min_scalar_type(classes))  # a short type sorts fastest
    feature, threshold, child, shares, gain = [-1], [0.0], [0], [None], np.zeros(x.shape[1])
    todo = [(0, np.arange(len(x)), depth)]
    while todo:
        slot, rows, left = todo.pop()
        own, weight = y[rows], w[rows]
        total = np.bincount(own, weight, classes)
        shares[slot] = total / total.sum()
        if left == 0 or (own == own[0]).all():
            continue
        features = order(slot)
        for s in range(0, len(features), mtry):
            some = features[s : s + mtry]
            better, column, cut = _cut(flat.take((some * len(x))[:, None] + rows), own, weight, total)
            if better > -np.inf:
                f = int(some[column])
                gain[f] += max(better, 0.0)
                feature[slot], threshold[slot], child[slot] = f, cut, len(feature)
                right = columns[f].take(rows) > cut
                for part in (rows[~right], rows[right]):
                    todo.append((len(feature), part, left - 1))
                    for column_of, empty in ((feature, -1), (threshold, 0.0), (child, 0), (shares, None)):
                        column_of.append(empty)
                break
    return feature, threshold, child, np.array(shares), gain


def packed(classes: Sequence[int], feature: Sequence[int], threshold: Sequence[float], child: Sequence[int], shares: np.ndarray) -> bytes:
    """16 bytes a node and each different share of the leaves once; a leaf has its share's place instead of a child."""
    leaf = np.asarray(feature) < 0
    table, place = np.unique(np.asarray(shares, "<f4")[leaf], axis=0, return_inverse=True)
    child = np.array(child)
    child[leaf] = place.reshape(-1)
    parts = ([len(feature), len(classes), len(table), *classes], "<i4"), (feature, "<i4"), (child, "<i4"), (threshold, "<f8"), (table, "<f4")
    return b"".join(np.asarray(v, kind).tobytes() for v, kind in parts)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, feature, child, threshold and, for the leaves, shares of the nodes."""
    n, c, k = np.frombuffer(raw, "<i4", 3)
    at, out = 12, []
    for size, kind in ((c, "<i4"), (n, "<i4"), (n, "<i4"), (n, "<f8"), (k * c, "<f4")):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out[0], out[1], out[2], out[3], out[4].reshape(k, c)[np.where(out[1] < 0, out[2], 0)]


def votes(x: np.ndarray, pieces: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and the sum of the pieces' class shares for each row."""
    classes, total = None, None
    for _, tree in pieces.groupby("tree"):
        cut = tree[tree["feature"].notna()]
        reached = route(x, {int(n): (int(f), t) for n, f, t in zip(cut["node"], cut["feature"], cut["threshold"])})
        for node, raw in zip(tree["node"], tree["nodes"]):
            if raw is None:
                continue
            classes, feature, child, threshold, shares = unpacked(raw)
            total = np.zeros((len(x), len(classes))) if total is None else total
            rows = np.flatnonzero(reached == node)
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                at[inner] = child[here] + (x[rows[inner], feature[here]] > threshold[here])
            total[rows] += shares[at]
    return (np.zeros(0, np.int32), np.zeros((len(x), 0))) if total is None else (classes, total)


def narrow(column: pa.Array) -> pa.Array:
    """Vectors as binary: 4 bytes a number in batches that lose nothing by it, 8 in others. A missing number is NaN."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        short = values.astype("<f4")
    kept = short if ((short == values) | np.isnan(values)).all() else values.astype("<f8")
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]) * kept.itemsize
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(kept.tobytes())])


def narrowed(df: DataFrame) -> DataFrame:
    """``df`` with its last column, vectors, as binary ``_x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], narrow(b.columns[-1])], [*names, "_x"])

    names = df.columns[:-1]
    return df.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes[:-1]), "_x binary"]))


def matrix(rows: list[bytes], d: int) -> np.ndarray:
    """The vectors of ``d`` numbers that ``narrow`` packed."""
    out, wide = np.empty((len(rows), d)), np.fromiter((len(r) > 4 * d for r in rows), bool, len(rows))
    for kind, at in (("<f4", ~wide), ("<f8", wide)):
        out[at] = np.frombuffer(b"".join(compress(rows, at)), kind).reshape(-1, d)
    return out


# ---------------------------------------------------------------- fitting


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, object]]:
    """Slices of a batch that belong to one model (first column)."""
    for whole in batches:
        for s in range(0, whole.num_rows, rows):
            b = whole.slice(s, rows)
            key = np.array(b.column(0).to_pylist(), object)
            for k in dict.fromkeys(key):
                yield b.take(pa.array(np.flatnonzero(key == k))), k


def _level(points: DataFrame, top: dict, open_nodes: dict, edges: np.ndarray, classes: list[int], mtry: int, seed: int, model: str, drawn: Draw) -> list:
    """Class counts left and right of the best binned split of every open node: (model, tree, node, gain, feature, threshold, left, right)."""
    d, kind = len(edges), dict(points.dtypes)[model]
    number = {c: i for i, c in enumerate(classes)}

    def features(tree: int, node: int, wide: bool) -> np.ndarray:
        order = chosen(d, mtry, seed, tree, node)
        return order if wide else order[:mtry]

    def sparse(total: np.ndarray) -> tuple[bytes | None, bytes]:
        """Places and values of the counts, or all counts, whatever is shorter."""
        at = np.flatnonzero(total).astype(np.int32)
        return (at.tobytes(), total[at].tobytes()) if 2 * len(at) < len(total) else (None, total.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        key_type = None

        def out() -> Iterator[pa.RecordBatch]:
            while held:  # a hundred nodes at a time, so little is there twice
                keys = list(held)[:100]
                columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((key_type, pa.int32(), pa.int64()))]
                packs = [pa.array(v, pa.binary()) for v in zip(*[sparse(held.pop(k)) for k in keys])]
                yield pa.RecordBatch.from_arrays([*columns, *packs], [model, "tree", "node", "cells", "counts"])

        size = 0
        for b, key in _sliced(batches):
            key_type = b.schema.field(0).type
            h, y = b.column(1).to_numpy().view(np.uint64), np.array([number[c] for c in b.column(2).to_pylist()])
            x = matrix(b.column(3).to_pylist(), d)
            cell = np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, x.T)], axis=1) * len(classes) + y[:, None]
            for (m, tree), nodes in open_nodes.items():
                if m != key:
                    continue
                w, reached = drawn(h, tree), route(x, top.get((m, tree), {}))
                for node, wide in nodes.items():
                    rows = np.flatnonzero((reached == node) & (w > 0))
                    if not len(rows):
                        continue
                    some = features(tree, node, wide)
                    if (m, tree, node) not in held:
                        held[m, tree, node] = np.zeros(len(some) * BINS * len(classes), np.int32)
                        size += held[m, tree, node].nbytes
                    at = cell[np.ix_(rows, some)] + np.arange(len(some)) * (BINS * len(classes))
                    held[m, tree, node] += np.bincount(at.ravel(), np.repeat(w[rows], len(some)), len(held[m, tree, node])).astype(np.int32)
            if size > HELD:
                yield from out()
                size = 0
        yield from out()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: list, total: np.ndarray) -> pa.RecordBatch:
            some = features(key[1], key[2], open_nodes[key[0], key[1]][key[2]])
            left = np.cumsum(total.reshape(len(some), BINS, len(classes)), axis=1)
            whole = left[0, -1]
            left = left[:, :-1]
            right = whole - left
            n, m = left.sum(-1), right.sum(-1)
            score = np.where((n > 0) & (m > 0), (left**2).sum(-1) / np.maximum(n, 1) + (right**2).sum(-1) / np.maximum(m, 1), -np.inf)
            i, j = np.unravel_index(int(score.argmax()), score.shape)
            gain = float(score[i, j] - (whole**2).sum() / whole.sum())
            row = [[key[0]], [key[1]], [key[2]], [gain], [int(some[i])], [float(edges[some[i]][j])], [left[i, j].tolist()], [right[i, j].tolist()]]
            kinds = (key_type, pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], [model, "tree", "node", "gain", "feature", "threshold", "left", "right"])

        current, total, key_type = None, None, None
        for b in batches:
            key_type = b.schema.field(0).type
            for *key, cells, raw in zip(*[c.to_pylist() for c in b.columns]):
                if key != current:
                    if current is not None:
                        yield done(current, total)
                    current, total = key, np.zeros(len(features(key[1], key[2], open_nodes[key[0], key[1]][key[2]])) * BINS * len(classes))
                total[slice(None) if cells is None else np.frombuffer(cells, np.int32)] += np.frombuffer(raw, np.int32)
        if current is not None:
            yield done(current, total)

    keys = [q(model), "tree", "node"]
    sums = points.mapInArrow(count, f"`{model}` {kind}, tree int, node long, cells binary, counts binary").repartition(*keys).sortWithinPartitions(*keys)
    schema = f"`{model}` {kind}, tree int, node long, gain double, feature int, threshold double, left array<double>, right array<double>"
    return sums.mapInArrow(split, schema).collect()


def _large_nodes(
    points: DataFrame, counts: dict, d: int, classes: list[int], trees: int, depth: int, mtry: int, seed: int, model: str, drawn: Draw
) -> tuple[dict, list]:
    """Splits of all nodes of more than LEAF_ROWS rows, and table rows for these splits and for leaves among their children."""
    top: dict = {}
    rows: list = []
    open_nodes = {(m, t): {1: False} for m, n in counts.items() if n > LEAF_ROWS for t in range(trees)}
    if not open_nodes:
        return top, rows
    sample = points.orderBy("_h", "_x").limit(max(BINS, min(EDGE_ROWS, EDGE_NUMBERS // d))).select("_x").collect()
    edges = np.quantile(matrix([bytes(r[0]) for r in sample], d), np.arange(1, BINS) / BINS, axis=0, method="lower").T

    def leaf(m: object, tree: int, node: int, count: Sequence[float]) -> None:
        share = np.array([count]) / sum(count)
        rows.append((m, tree, node, None, None, packed(classes, [-1], [0.0], [0], share), [0.0] * d))

    while open_nodes:
        level, open_nodes = _level(points, top, open_nodes, edges, classes, mtry, seed, model, drawn), {k: {n: True for n, wide in v.items() if not wide} for k, v in open_nodes.items()}
        following: dict = {}
        for r in level:
            m, tree, node = r[model], r["tree"], r["node"]
            if r["gain"] == -math.inf:
                if node not in open_nodes[m, tree]:  # all features were looked at
                    leaf(m, tree, node, [a + b for a, b in zip(r["left"], r["right"])])
                else:
                    following.setdefault((m, tree), {})[node] = True
                continue
            top.setdefault((m, tree), {})[node] = (r["feature"], r["threshold"])
            gain = [0.0] * d
            gain[r["feature"]] = max(r["gain"], 0.0)
            rows.append((m, tree, node, r["feature"], r["threshold"], None, gain))
            for child, count in ((2 * node, r["left"]), (2 * node + 1, r["right"])):
                if sum(c > 0 for c in count) < 2 or child.bit_length() > depth:
                    leaf(m, tree, child, count)
                elif sum(count) > LEAF_ROWS:
                    following.setdefault((m, tree), {})[child] = False
        open_nodes = following
    return top, rows


def fit_forests(
    df: DataFrame, ids: Sequence[str], trees: int = 50, depth: int = DEEPEST, arr: str = "features", label: str = "label",
    model: str | None = None, seed: int = 42, mtry: int | None = None, bootstrap: bool = True,
) -> Forest:
    """One forest for each value of the column ``model`` (one in all without it), all grown in the same passes.

    Rows need ids for the bootstrap: rows with equal ids are drawn together. Rows without label, or with a missing or null
    number in ``arr``, are left out. Every node looks at ``mtry`` features, the square root of their number by default.
    """
    with dropped_shuffles(df.sparkSession):
        return _fit(df, ids, trees, depth, arr, label, model, seed, mtry, bootstrap)


def _fit(
    df: DataFrame, ids: Sequence[str], trees: int, depth: int, arr: str, label: str, model: str | None, seed: int, mtry: int | None, bootstrap: bool
) -> Forest:
    key = model or "model"
    whole = q(arr).isNotNull() & q(label).isNotNull() & F.forall(q(arr), lambda v: F.coalesce(~F.isnan(v.cast("double")), F.lit(False)))
    cols = [(q(model) if model else F.lit(0)).alias(key), F.xxhash64(*[q(c) for c in ids]).alias("_h"), q(label).cast("int").alias("_y"), F.size(q(arr)).alias("_n"), q(arr).cast("array<double>").alias("_x")]
    points = narrowed(df.where(whole).select(*cols))
    if model:  # a task then has rows of few models, and counts for few nodes
        points = points.repartitionByRange(q(key), "_h")
    points = settle(points)
    held = points.groupBy(key).agg(F.count("*"), F.sum(F.length("_x"))).collect()  # one row per model
    counts, size = {r[0]: r[1] for r in held}, sum(r[2] + 64 * r[1] for r in held)
    if not counts:
        raise ValueError("no rows to grow a forest from")
    sizes = [r[0] for r in points.select("_n").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    points = points.drop("_n")
    d, kind = sizes[0], dict(points.dtypes)[key]
    classes = sorted(r[0] for r in points.select("_y").distinct().collect())
    number = {c: i for i, c in enumerate(classes)}
    some = mtry or max(1, math.isqrt(d))

    def drawn(h: np.ndarray, tree: int) -> np.ndarray:
        return bag(h, tree, seed) if bootstrap else np.ones(len(h), np.int64)

    top, rows = _large_nodes(points, counts, d, classes, trees, depth, some, seed, key, drawn)
    finished: dict = {}
    for m, t, n, f, *_ in rows:
        if f is None:
            finished.setdefault((m, t), []).append(n)

    def sent(first: int, end: int) -> DataFrame:
        """The rows of some trees, once for each tree, with the node that they reach there."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, k in _sliced(batches, 1024):
                h, x = b.column(1).to_numpy().view(np.uint64), matrix(b.column(3).to_pylist(), d)
                for tree in range(first, end):
                    w = drawn(h, tree)
                    node = route(x, top.get((k, tree), {}))
                    at = np.flatnonzero((w > 0) & ~np.isin(node, finished.get((k, tree), [])))
                    rest = b.take(pa.array(at))
                    columns = [rest.column(0), pa.array(np.full(len(at), tree, np.int32)), pa.array(node[at]), pa.array(w[at].astype(np.int32)), *rest.columns[1:]]
                    yield pa.RecordBatch.from_arrays(columns, [key, "tree", "node", "w", "_h", "_y", "_x"])

        return points.mapInArrow(send, f"`{key}` {kind}, tree int, node long, w int, _h long, _y int, _x binary")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(part: pa.Table) -> pa.RecordBatch:
            t, node = part.column(1)[0].as_py(), part.column(2)[0].as_py()
            x = matrix(part.column(6).to_pylist(), d)
            count = np.zeros((len(x), len(classes)))
            count[np.arange(len(x)), [number[c] for c in part.column(5).to_pylist()]] = part.column(3).to_numpy()
            rng = np.random.default_rng([seed & 0xFFFFFFFF, t, node, 1])
            *nodes, gain = grow(x, count, depth - (node.bit_length() - 1), some, lambda _: rng.permutation(d))
            out = ([part.column(0)[0].as_py()], part.schema.field(0).type), ([t], pa.int32()), ([node], pa.int64()), ([None], pa.int32()), ([None], pa.float64()), ([packed(classes, *nodes)], pa.binary()), ([gain.tolist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in out], [key, "tree", "node", "feature", "threshold", "nodes", "gain"])

        held, current = [], None
        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(3)]))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if held and keys[s] != current:
                    yield tree(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                current = keys[s]
        if held:
            yield tree(pa.Table.from_batches(held))

    schema = f"`{key}` {kind}, tree int, node long, feature int, threshold double, nodes binary, gain array<double>"
    order = [q(key), "tree", "node"]
    # A task a piece, about: growing one takes far longer than its few MB say, by which Spark would put many into a task.
    pieces = sum(math.ceil(2 * n / LEAF_ROWS) for n in counts.values())
    at_once = max(1, min(trees, WAVE // size))  # rows travel once for each tree: so many trees that their rows fit the disks

    def grown() -> Iterator[DataFrame]:
        for s in range(0, trees, at_once):
            e = min(s + at_once, trees)
            yield sent(s, e).repartition(min(TASKS, (e - s) * pieces), *order).sortWithinPartitions(*order, "_h").mapInArrow(finish, schema)
        if rows:  # one for each large node
            yield df.sparkSession.createDataFrame(rows, schema)

    return Forest(settle_in_turn(grown()), key)


# ---------------------------------------------------------------- scoring


def apply_models(rows: DataFrame, models: DataFrame, model: str, predict: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``predict(model's rows, rows)`` for every block of rows of each model key, in one pass over all pairs.

    Rows whose key has no model are not in the result. A model must fit a task.
    """
    rows = settle(rows)  # read twice
    blocks = rows.groupBy(q(model).alias("_k")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    cut = rows.join(blocks, q(model) == F.col("_k")).withColumn("_block", F.pmod(F.xxhash64(*[q(c) for c in rows.columns]), F.col("_blocks")).cast("int")).drop("_k", "_blocks")
    dealt = models.join(blocks, q(model) == F.col("_k")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_k", "_blocks")

    def run(data: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(own):
            return pd.DataFrame()
        return predict(own.drop(columns="_block"), data.drop(columns="_block").reset_index(drop=True))

    return cut.groupBy(q(model), "_block").cogroup(dealt.groupBy(q(model), "_block")).applyInPandas(run, schema)


def predict_forests(df: DataFrame, forest: Forest, arr: str = "features", model: str | None = None, out: str = "pred") -> DataFrame:
    """``df`` with the class that the forest of the row's ``model`` finds likeliest (the smallest among equals) in ``out``.

    Without ``model`` the table's only forest scores all rows. A missing number goes to the lower side; a null array,
    or one of another length than the fitted ones, gets no class, as a row whose model there is none of.
    """
    key, digits = forest.model, 4  # sums of shares in another order are the same to so many digits
    held = forest.table.groupBy(q(key).alias("_m")).agg(F.coalesce(F.sum(F.length("nodes")), F.lit(0)).alias("_bytes"), F.max(F.size("gain")).alias("_d"), (F.max("tree") + 1).alias("_trees"))
    most = held.agg(F.max("_bytes"), F.max("_d"), F.max("_m"), F.max(F.col("_bytes") / F.col("_trees"))).first()
    numbered = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    asked = (q(model) if model else F.lit(most[2])).alias("_m")
    rows = narrowed(numbered.where(F.size(arr) == most[1]).select(asked, "_row", q(arr).cast("array<double>").alias("_x")))
    columns = ["tree", "node", "feature", "threshold", "nodes"]

    def shares(own: pd.DataFrame, data: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return votes(matrix(data["_x"].tolist(), most[1]), own)

    if most[0] <= CHUNK:  # every model fits a task

        def score(own: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
            classes, total = shares(own, data)
            return pd.DataFrame({"_row": data["_row"], out: classes[total.round(digits).argmax(axis=1)]})

        best = apply_models(rows, forest.table.select(q(key).alias("_m"), *columns), "_m", score, f"_row long, `{out}` int")
    else:  # chunks of trees, or of pieces of a tree with its large splits, so no row asks more chunks than there are trees

        def score(own: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
            classes, total = shares(own, data)
            return pd.DataFrame({"_row": data["_row"], "c": [classes.tolist()] * len(total), "t": total.tolist()})

        trees, number = F.col("_trees"), F.col("_chunks")
        per = F.ceil(number / trees).cast("int")
        chunks = settle(held.select("_m", F.greatest(F.lit(1), F.ceil(F.col("_bytes") / CHUNK)).cast("int").alias("_chunks"), "_trees").withColumn("_per", per))
        own = F.when(number <= trees, F.col("tree") % number).otherwise(F.col("tree") + trees * F.pmod("node", "_per").cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.col("_per") - 1), lambda i: F.col("tree") + trees * i)
        every = F.when(F.col("feature").isNull() | (number <= trees), F.array(own)).otherwise(parts)
        table = forest.table.join(chunks, q(key) == F.col("_m")).withColumn("_c", F.explode(every))
        pair = F.to_json(F.struct("_m", "_c")).alias("_pair")
        sized = rows.join(chunks, "_m")
        asking = sized.where(number <= trees).withColumn("_c", F.explode(F.sequence(F.lit(0), number - 1))).select("_m", "_c", "_row", "_x")
        if most[3] > CHUNK:  # more chunks than trees: a row asks the one part of each tree that it reaches
            top: dict = {}
            large = held.where(F.col("_bytes") > CHUNK * trees).select("_m")
            for r in forest.table.join(large, q(key) == F.col("_m")).where("feature is not null").select("_m", *columns[:4]).collect():  # one for each large node
                top.setdefault((r[0], r[1]), {})[r[2]] = (r[3], r[4])

            def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b, k in _sliced(batches):
                    x, of, parts_of = matrix(b.column(2).to_pylist(), most[1]), b.column(3)[0].as_py(), b.column(4)[0].as_py()
                    for tree in range(of):
                        c = tree + of * (route(x, top.get((k, tree), {})) % parts_of)
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int32)), *b.columns[1:3]], ["_m", "_c", "_row", "_x"])

            beyond = sized.where(number > trees).select("_m", "_row", "_x", "_trees", "_per")
            asking = asking.unionByName(beyond.mapInArrow(reaching, f"_m {dict(sized.dtypes)['_m']}, _c int, _row long, _x binary"))
        asking = asking.select(pair, "_row", "_x")
        counted = apply_models(asking, table.select(pair, *columns), "_pair", score, "_row long, c array<int>, t array<double>")
        each = counted.select("_row", F.explode(F.arrays_zip("c", "t")).alias("_z")).groupBy("_row", F.col("_z.c").alias("c")).agg(F.sum("_z.t").alias("t"))
        best = each.groupBy("_row").agg(F.max_by("c", F.struct(F.round("t", digits), -F.col("c"))).alias(out))
    return numbered.drop(out).join(best, "_row", "left").drop("_row")


def importances(forest: Forest) -> DataFrame:
    """``model, feature, importance``: each tree's gains add up to 1, averaged over the trees with any."""
    key = q(forest.model)
    gains = forest.table.select(key, "tree", F.posexplode("gain").alias("feature", "gain")).groupBy(key, "tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = gains.groupBy(key, "tree").agg(F.sum("gain").alias("_all")).where("_all > 0")
    shares = gains.join(whole, [forest.model, "tree"]).groupBy(key, "feature").agg(F.sum(F.col("gain") / F.col("_all")).alias("_s"))
    trees = whole.groupBy(key).agg(F.count("*").alias("_n"))
    return shares.join(trees, [forest.model]).select(key, "feature", (F.col("_s") / F.col("_n")).alias("importance"))
