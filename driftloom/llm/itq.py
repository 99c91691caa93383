"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated principal components are balanced bits that
lose as little as possible: bits and rotation are fitted to each other in turn. Vectors at the threshold's cosine differ
in few bits; how many is measured on the sample, and that radius is searched exactly. The code is cut into substrings,
one table each. Two codes within the radius agree in one of them but for a few bits (pigeonhole), so each vector is
filed once a table and asks the cells of all keys that near its own. Pairs found are reranked with the original vectors.

The number of tables follows from the number of vectors, as in any multi-index table; the radius that is searched, and
so the result, doesn't depend on it. A pair belongs to the first table in which its codes meet, so none is counted
twice. Equal vectors are one node from the start. Cells of more than a bounded number of codes are cut and dealt cut by
cut. Pairs are never rows: codes that meet go on as blocks of nodes, a block's links are counted in its task, and it hands
on a count and one link per node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from driftloom.llm.components import connect
from driftloom.llm.text import column, map_batches
from driftloom.session import settle

COSINE = 0.98
#: Bits of a code; vectors of more numbers than WIDTH are folded to that many for their code (never for the rerank).
BITS, WIDTH = 64, 256
#: The rotation is fitted on this many distinct vectors at most (those with the smallest hashes).
SAMPLE, ROUNDS = 8192, 50
#: The share of pairs at the threshold that may differ in more bits than the radius.
MISSED = 0.0005
#: Codes of a cell that are dealt together, nodes on either side of a block, pairs of codes compared at once.
CELL, BLOCK, PAIRS = 4096, 1024, 1 << 20
#: Relative cost of a row that is dealt and of a pair of codes, for choosing the tables.
ROW_COST, PAIR_COST, PROBES = 3e-6, 5e-9, 20_000

CELLS = "g long, t int, key long, node long, code long"


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length with norm 1; scaled first, so that no square is too large or small."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` (rows) in ``width`` columns: short vectors get zeros, of long ones every width-th number is added or subtracted."""
    n, d = x.shape
    out = np.zeros((n, -(-d // width) * width))
    out[:, :d] = x
    turns = out.reshape(n, -1, width)
    return (turns * np.resize([1.0, -1.0, -1.0], turns.shape[1])[:, None]).sum(axis=1)


@dataclass
class Model:
    """A fitted code: bit i of a vector is the sign of ``x @ directions[:, i] - offset[i]``."""

    directions: np.ndarray
    offset: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = folded(x, len(self.directions)) @ self.directions > self.offset
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def fit(x: np.ndarray, numbers: int, cosine: float) -> Model:
    """The code learned from rows of folded unit vectors of ``numbers`` numbers."""
    rng = np.random.default_rng(13)
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]  # as many as bits: width is never smaller
    parts = centred @ axes
    rotation = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(ROUNDS):
        bits = np.where(parts @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(bits.T @ parts)
        rotation = right.T @ left.T
    directions = axes @ rotation
    model = Model(directions, mean @ directions, 0)
    # pairs at the threshold: away from a vector in any direction, and in the direction of another vector
    start = x[rng.integers(0, len(x), 8192)]
    noise = np.zeros_like(start)
    noise[:, : min(numbers, x.shape[1])] = rng.standard_normal((len(start), min(numbers, x.shape[1])))
    most = 1
    for away in (noise, x[rng.integers(0, len(x), len(start))]):
        scale = np.maximum((start * start).sum(axis=1, keepdims=True), 1e-300)
        away = away - (away * start).sum(axis=1, keepdims=True) / scale * start
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        some = norm[:, 0] > 1e-9
        near = cosine * start + np.sqrt(1 - cosine**2) * np.sqrt(scale) * away / np.maximum(norm, 1e-300)
        if some.any():
            flips = np.bitwise_count(model.codes(start[some]) ^ model.codes(near[some]))
            most = max(most, int(np.quantile(flips, 1 - MISSED, method="higher")))
    return Model(directions, mean @ directions, most)


@dataclass
class Tables:
    """Substrings of the code: a key is ``code >> shift & ones``; codes meet in a table if their keys differ in ``near`` bits at most."""

    shift: list[int]
    width: list[int]
    near: list[int]

    def key(self, t: int, code: np.ndarray) -> np.ndarray:
        return (code >> np.uint64(self.shift[t])) & np.uint64((1 << self.width[t]) - 1)

    def masks(self, t: int) -> np.ndarray:
        """What a key and one that nears it differ by; nothing comes first."""
        return np.array([sum(1 << i for i in c) for n in range(min(self.near[t], self.width[t]) + 1) for c in combinations(range(self.width[t]), n)], np.uint64)

    def meet(self, t: int, apart: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.key(t, apart)) <= self.near[t]

    def first(self, t: int, apart: np.ndarray) -> np.ndarray:
        """Whether table ``t`` is the first one in which codes that are ``apart`` meet."""
        out = self.meet(t, apart)
        for u in range(t):
            out &= ~self.meet(u, apart)
        return out


def probes(width: int, near: int) -> int:
    return sum(comb(width, n) for n in range(near + 1))


def tables(radius: int, n: int) -> Tables:
    """The cheapest cut of the code into substrings for groups of ``n`` codes that finds every pair within ``radius``.

    With m substrings one of them has radius // m differing bits or less; the first radius % m + 1 of them are enough for
    that many, for the others one less will do.
    """
    best = (float("inf"), None)
    for m in range(1, min(radius + 1, BITS) + 1):
        width = [BITS // m + (i < BITS % m) for i in range(m)]
        near = [radius // m - (i > radius % m) for i in range(m)]
        asked = [probes(w, r) for w, r in zip(width, near)]
        cost = sum(p * (ROW_COST + PAIR_COST * n / 2**w) for p, w in zip(asked, width))
        if cost < best[0] and max(asked) <= PROBES:
            best = (cost, Tables([sum(width[:i]) for i in range(m)], width, near))
    return best[1]


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """``vec_id, g, digest, numbers, vector`` per row, the last four null for rows that can't be linked, and the vectors' number type."""
    kind = "<f4" if df.select(column(vector_col)).dtypes[0][1] == "array<float>" else "<f8"
    label = column(label_col)
    g = F.when(label.isNotNull(), F.xxhash64(label, F.size(column(vector_col))))
    rows = df.select(column(id_col).cast("long").alias("vec_id"), g.alias("g"), column(vector_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        lists, group = b.column(2), b.column(1).to_pylist()
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        found: list[bytes | None] = [None] * b.num_rows
        for d in np.unique(length[length > 0]):
            at = np.flatnonzero(length == d)
            x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)  # null is NaN
            for i in np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)):
                if group[at[i]] is not None:
                    found[at[i]] = (x[i] + x.dtype.type(0)).tobytes()  # no negative zero
        digest = [v and xxh3_128_digest(group[i].to_bytes(8, "little", signed=True) + v) for i, v in enumerate(found)]
        size = [None if v is None else len(v) // int(kind[-1]) for v in found]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(found, pa.binary())], ["vec_id", "g", "digest", "numbers", "vector"])

    return map_batches(rows, batch, "vec_id long, g long, digest binary, numbers int, vector binary"), kind


def of_length(batch: pa.RecordBatch, kind: str, column: str = "vector") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the batch and their unit vectors, for each length of vectors in it."""
    raw = batch.column(batch.schema.get_field_index(column)).to_pylist()
    length = np.array([len(v) for v in raw])
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, units([raw[i] for i in at], kind)


def learned(nodes: DataFrame, kind: str, cosine: float) -> Model | None:
    """The model fitted on the sample; None without nodes."""
    numbers = nodes.agg(F.max("numbers")).first()[0]
    if numbers is None:
        return None
    width = max(BITS, min(numbers, WIDTH))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((b.num_rows, width), "<f4")
        for at, x in of_length(b, kind):
            out[at] = folded(x, width)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["digest", "x"])

    chosen = map_batches(nodes.select("digest", "vector"), batch, "digest binary, x binary").orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).collect()
    return fit(np.frombuffer(b"".join(r.x for r in chosen), "<f4").reshape(-1, width).astype(np.float64), numbers, cosine)


def coded(nodes: DataFrame, kind: str, model: Model) -> DataFrame:
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros(b.num_rows, "<u8")
        for at, x in of_length(b, kind):
            out[at] = model.codes(x)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view("<i8"))], ["node", "g", "code"])

    return map_batches(nodes.select("node", "g", "vector"), batch, "node long, g long, code long")


def filed(codes: DataFrame, index: Tables) -> DataFrame:
    """A row per table of each code."""
    m = len(index.shift)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        node, g, code = (b.column(i).to_numpy() for i in range(3))
        keys = np.stack([index.key(t, code.view(np.uint64)) for t in range(m)], axis=1).astype(np.int64)
        every = [np.repeat(g, m), np.tile(np.arange(m, dtype=np.int32), len(g)), keys.ravel(), np.repeat(node, m), np.repeat(code, m)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in every], ["g", "t", "key", "node", "code"])

    return map_batches(codes, batch, CELLS)


def near_keys(cells: DataFrame, index: Tables, smaller: bool) -> DataFrame:
    """Each row once for every key that nears its own, in ``to``; keys smaller than its own only if ``smaller``."""
    masks = [index.masks(t) for t in range(len(index.shift))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                table, key = b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
                for t in np.unique(table):
                    at = np.flatnonzero(table == t)
                    to = key[at, None] ^ masks[t]
                    row, probe = np.nonzero((to >= key[at, None]) | smaller)
                    yield b.take(pa.array(at[row])).append_column("to", pa.array(to[row, probe].view(np.int64)))

    fields = ", ".join(f"`{n}` {k}" for n, k in cells.dtypes)
    return cells.mapInArrow(run, f"{fields}, `to` long")


def dealt(codes: DataFrame, index: Tables) -> DataFrame:
    """``g, t, to, a, b, asks, node, code``: in a group (g, t, to, a, b) the rows that ask meet those that live in cell ``to``.

    A cell of more than CELL codes is cut; a group holds one cut of the cell and one cut of the cells that near it.
    Of two different cells the one with the smaller key asks; a cell asks itself too.
    """
    cells = settle(filed(codes, index))
    hot = settle(cells.groupBy("g", "t", "key").count().filter(F.col("count") > CELL).select("g", "t", "key", F.ceil(F.col("count") / CELL).cast("int").alias("cuts")))
    cut = F.coalesce(F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.lit(0))
    placed = cells.join(hot, ["g", "t", "key"], "left").select(*cells.columns, cut.alias("cut"))
    asks = near_keys(placed, index, False).withColumnRenamed("cut", "a")
    asks = asks.join(hot.withColumnRenamed("key", "to"), ["g", "t", "to"], "left")
    asks = asks.select("g", "t", "to", "a", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)).alias("b"), F.lit(True).alias("asks"), "node", "code")
    reach = near_keys(hot, index, True).groupBy("g", "t", "to").agg(F.max("cuts").alias("most"))
    lives = placed.withColumnsRenamed({"key": "to", "cut": "b"}).join(reach, ["g", "t", "to"], "left")
    lives = lives.select("g", "t", "to", F.explode(F.sequence(F.lit(0), F.coalesce("most", F.lit(1)) - 1)).alias("a"), "b", F.lit(False).alias("asks"), "node", "code")
    return asks.unionByName(lives)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, equal in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        same = held and all(held[-1].column(i)[-1].as_py() == c[0] for i, c in enumerate(columns))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, b.slice(0, change[-1])])
            held = [b.slice(change[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def group_numbers(columns: list[np.ndarray]) -> np.ndarray:
    """0, 0, 1, ... for sorted rows."""
    return np.concatenate([[0], np.cumsum(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))])


def meeting(t: np.ndarray, apart: np.ndarray, mine: np.ndarray, other: np.ndarray, index: Tables, radius: int) -> np.ndarray:
    """Whether pairs of codes that are ``apart`` are within the radius and belong to table ``t``; in a cell the smaller node asks."""
    out = np.bitwise_count(apart) <= radius
    for u in np.unique(t):
        of = t == u
        out &= ~of | (index.first(u, apart) & ((index.key(u, apart) != 0) | (mine < other)))
    return out


def blocks(groups: DataFrame, index: Tables, radius: int) -> DataFrame:
    """``block, t, asks, node, code``: nodes that meet another one in a block of BLOCK by BLOCK nodes of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for table in whole_groups(batches, 5):
            g, t, to, a, b, asks, node, code = (table.column(i).to_numpy() for i in range(8))
            code = code.view(np.uint64)
            group = group_numbers([g, t, to, a, b])
            start = np.searchsorted(group, np.arange(group[-1] + 2))
            lives = np.bincount(group, ~asks, group[-1] + 1).astype(np.int64)  # they are first in a group
            asker = np.flatnonzero(asks)
            pairs = lives[group[asker]]
            edges = np.concatenate([[0], np.cumsum(pairs)])
            found, s = [], 0
            while s < len(asker):
                e = max(s + 1, int(np.searchsorted(edges, edges[s] + PAIRS, "right")) - 1)
                x = np.repeat(asker[s:e], pairs[s:e])
                y = np.arange(len(x)) - np.repeat(edges[s:e] - edges[s], pairs[s:e]) + start[group[x]]
                ok = meeting(t[x], code[x] ^ code[y], node[x], node[y], index, radius)
                # a place is a block and a side: rows on it are distinct
                x, y = x[ok], y[ok]
                part = np.stack([group[x], (x - start[group[x]] - lives[group[x]]) // BLOCK, (y - start[group[y]]) // BLOCK], axis=1)
                for side in (x, y):
                    found.append(np.unique(np.column_stack([part, side]), axis=0))
                s = e
            rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
            if not len(rows):
                continue
            block = group_numbers([rows[:, i] for i in range(3)]) + number
            number, at = int(block[-1]) + 1, rows[:, 3]
            for s in range(0, len(at), 10_000):
                i = at[s : s + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (block[s : s + 10_000], t[i], asks[i], node[i], code[i].view(np.int64))], ["block", "t", "asks", "node", "code"])

    keys = ["g", "t", "to", "a", "b"]
    return groups.repartition(*keys).sortWithinPartitions(*keys, "asks", "node").mapInArrow(run, "block long, t int, asks boolean, node long, code long")


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v) and the smallest node each one reaches."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return node, node[label]
        label = new


def linked(parts: DataFrame, nodes: DataFrame, index: Tables, radius: int, kind: str, cosine: float) -> DataFrame:
    """``node, links, near`` for nodes with links in a block: how many vectors, and the smallest node it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            edge = np.flatnonzero(np.diff(table.column(0).to_numpy(), prepend=-1, append=-1))
            for s, e in zip(edge, edge[1:]):
                part = table.slice(s, e - s).combine_chunks()
                t, asks, node, code, copies = (part.column(i).to_numpy() for i in range(1, 6))
                x = units(part.column(6).to_pylist(), kind)
                i, j = np.flatnonzero(asks), np.flatnonzero(~asks)
                hit, near = np.nonzero(x[i] @ x[j].T >= cosine)
                i, j = i[hit], j[near]
                code = code.view(np.uint64)
                ok = meeting(t[i], code[i] ^ code[j], node[i], node[j], index, radius)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                reached, smallest = smallest_reachable(node[i], node[j])
                links = np.zeros(len(reached), np.int64)
                for one, other in ((i, j), (j, i)):
                    np.add.at(links, np.searchsorted(reached, node[one]), copies[other])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (reached, links, smallest)], ["node", "links", "near"])

    rows = parts.join(nodes.select("node", "copies", "vector"), "node").select("block", "t", "asks", "node", "code", "copies", "vector")
    return rows.repartition("block").sortWithinPartitions("block", "node", "asks").mapInArrow(run, "node long, links long, near long")


def near_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each input row.

    Rows of equal labels and equal lengths are linked if the cosine of their vectors is ``cosine`` or more; no other pair is ever
    linked, and a pair at the threshold is missed if its codes differ in more bits than ``MISSED`` of such pairs do.
    ``n_links`` counts the other rows linked directly, copies each; ``component_id`` is the smallest id reachable, and
    the vector of that id is kept. Vectors that are null, empty or zero, or hold null or non-finite components, and
    vectors without a label are linked with nothing. Rows of one id are vectors of their own. A row without an id is
    linked like others; where no vector reached has an id the component is null and its rows are kept. Other columns
    are not read. An empty table gives an empty result.
    """
    found, kind = vectors(df, id_col, vector_col, label_col)
    rows = settle(found)
    equal = rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("g", "numbers", "vector")])
    nodes = settle(equal.withColumn("node", F.monotonically_increasing_id()))  # numbers are fixed once they are written
    model = learned(nodes, kind, cosine)
    if model is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = tables(model.radius, nodes.groupBy("g").count().agg(F.max("count")).first()[0])
    parts = settle(blocks(dealt(settle(coded(nodes, kind, model)), index), index, model.radius))
    links = settle(linked(parts, nodes, index, model.radius, kind, cosine))
    labels = connect(settle(links.filter("node != near").select(F.col("node").alias("a"), F.col("near").alias("b")).distinct()))
    least = nodes.select("node", "digest", "copies", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = least.groupBy("label").agg(F.min("least").alias("component"))
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    told = least.join(named, "label").join(count, "node", "left")
    told = settle(told.select(F.col("digest").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"))
    out = rows.select("vec_id", "digest").join(told, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
