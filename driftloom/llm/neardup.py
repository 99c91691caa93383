"""Near-duplicate documents by SetSketch registers.

A document is its set of word shingles. Its sketch holds, for each of several hash functions, the smallest hash value as
an exponential number, truncated to powers of a base: the registers of a union are the larger ones of its parts, and two
sets agree in a register about as often as their similarity. Bands of registers find candidates, the likelihood of a
pair's larger, smaller and equal registers (given both set sizes) estimates its similarity, and the full sets decide.

Equal sets are one node from the start. In each bucket of a band all nodes are compared with the smallest one, first
one pair per node and then all that still join different components; what is left are buckets that hold several
components. There the nodes outside the bucket's largest component are compared with all of its nodes, in blocks of
bounded size, and only pairs that can't be ruled out leave the block. Pairs inside a component are never made, so a
large group of copies costs as much as its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from driftloom.llm.components import connect
from driftloom.llm.repeats import probably_in
from driftloom.llm.text import WordHashes, column, hashed_batches, lower_ascii, map_batches, mix, two_columns, utf8
from driftloom.session import settle

#: Registers of a sketch; base, rate and largest value of a register.
REGISTERS = 256
STEP, RATE, TOP = 1.001, 20.0, 65535
#: Registers per band, and bands; a band takes registers from all over the sketch, so bands overlap (see ``missed``).
BAND, BANDS = 7, 100
#: Candidates whose estimated similarity is this far below the threshold are not verified: five standard errors.
SLACK = 0.13
#: Bits of a set's bitmap, which bounds an intersection from above.
BITS = 4096
#: Nodes of a bucket that are compared in one go, and pairs evaluated at once.
BLOCK, PAIRS = 2048, 4096
STRETCH = 2048

_ODD = (mix(np.arange(REGISTERS, dtype=np.uint64), 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(REGISTERS, dtype=np.uint64), 22) >> np.uint64(32)).astype(np.uint32)
_PICK = np.argsort(mix(np.arange(BANDS * REGISTERS, dtype=np.uint64), 23).reshape(BANDS, REGISTERS), axis=1)[:, :BAND]
_GRID = np.linspace(0.0, 1.0, 101)


def shingles(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    w = hashes.of(words)
    k = min(k, len(w))
    n = len(w) - k + 1
    h = mix(w[:n], k)
    for j in range(1, k):
        h = mix(h ^ w[j : j + n], j)
    return np.unique(h)


def registers(h: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes."""
    x = (mix(h, 24) >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), STRETCH):
        np.minimum(least, (_ODD[:, None] * x[s : s + STRETCH] + _ADD[:, None]).min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(STEP)), 0, TOP).astype("<u2")


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in sketch.astype(np.uint64)[_PICK].T:
        key = mix(key ^ column, 25)
    return key.view(np.int64)


def missed(similarity: float) -> float:
    """The chance that two sets share no band: with e equal registers a band is shared with C(e, BAND) / C(REGISTERS, BAND).
    Bands use the same registers, so they aren't independent; given e they are, for bands drawn at random."""
    whole = comb(REGISTERS, BAND)
    equal = [comb(REGISTERS, e) * similarity**e * (1 - similarity) ** (REGISTERS - e) for e in range(REGISTERS + 1)]
    return sum(p * (1 - comb(e, BAND) / whole) ** BANDS for e, p in enumerate(equal))


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (pairs x registers) from sets of known sizes."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = _GRID * np.minimum(u / v, v / u)  # no larger similarity is possible for these sizes
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP)
    above, below = chance(u - v * j), chance(v - u * j)
    safe = lambda p: np.log(np.maximum(p, 1e-12))
    fit = larger[:, None] * safe(above) + smaller[:, None] * safe(below) + equal[:, None] * safe(1 - above - below)
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], 1)[:, 0]


def sketched(df: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, digest`` of the whole set (null: empty set) and ``sketch`` per row of (doc_id, text)."""

    def batch(b: pa.RecordBatch, hashes: WordHashes) -> pa.RecordBatch:
        sets = [shingles(lower_ascii(t).split(), k, hashes) for t in utf8(b.column(1))]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0).cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["doc_id", "n_shingles", "digest", "sketch"],
        )

    return hashed_batches(df, batch, "doc_id long, n_shingles long, digest binary, sketch binary")


def full_sets(df: DataFrame, k: int) -> DataFrame:
    def batch(b: pa.RecordBatch, hashes: WordHashes) -> pa.RecordBatch:
        sets = [shingles(lower_ascii(t).split(), k, hashes).tobytes() for t in utf8(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "members"])

    return hashed_batches(df, batch, "node long, members binary")


def bitmap(h: np.ndarray) -> bytes:
    on = np.zeros(BITS, bool)
    on[(h >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(on).tobytes()


def profiles(sets: DataFrame) -> DataFrame:
    """``node, n, sketch, bitmap`` of full sets."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(m, np.uint64) for m in b.column(1).to_pylist()]
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s).tobytes() for s in sets]), pa.array([bitmap(s) for s in sets])]
        return pa.RecordBatch.from_arrays([b.column(0), *columns], ["node", "n", "sketch", "bitmap"])

    return map_batches(sets, batch, "node long, n long, sketch binary, bitmap binary")


def possible(n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """False only for pairs that can't reach the threshold: a bit that one bitmap has alone is a member it has alone."""
    alone = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    most = np.minimum(n_a - alone(bits_a, bits_b), n_b - alone(bits_b, bits_a))
    return 100 * most >= percent * (n_a + n_b - most)


class Profiles:
    """Columns of profiles of some nodes, and tests on pairs of them."""

    def __init__(self, n: pa.Array, sketch: pa.Array, bits: pa.Array):
        self.n = n.to_numpy(zero_copy_only=False)
        self.sketch = np.frombuffer(b"".join(sketch.to_pylist()), "<u2").reshape(-1, REGISTERS)
        self.bits = np.frombuffer(b"".join(bits.to_pylist()), "<u8").reshape(-1, BITS // 64)

    def near(self, a: np.ndarray, other: Profiles, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the pairs (own row a, other's row b) may reach the threshold."""
        out = np.zeros(len(a), bool)
        for s in range(0, len(a), PAIRS):
            x, y = a[s : s + PAIRS], b[s : s + PAIRS]
            ok = possible(self.n[x], other.n[y], self.bits[x], other.bits[y], percent)
            x, y = x[ok], y[ok]
            if len(x):
                alike = likely_similarity(self.sketch[x], other.sketch[y], self.n[x].astype(float), other.n[y].astype(float))
                out[s + np.flatnonzero(ok)] = alike >= percent / 100 - SLACK
        return out


def buckets(nodes: DataFrame) -> DataFrame:
    """``key, node`` for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                keys = np.concatenate([band_keys(np.frombuffer(x, "<u2")) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long")


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their profiles."""
    of = lambda side: known.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch", "bitmap")])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (Profiles(*b.columns[i : i + 3]) for i in (2, 5))
        every = np.arange(b.num_rows)
        return b.select(["a", "b"]).filter(pa.array(left.near(every, right, every, percent)))

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "sketch_a", "bitmap_a", "n_b", "sketch_b", "bitmap_b")
    return map_batches(both, batch, "a long, b long")


def in_groups(named: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``key, part, node, asks, lives, label, n, sketch, bitmap``: the rows (key, node, label) of buckets of several labels,
    dealt so that any two nodes of different labels that may be linked meet in a group (key, part), one that asks and one
    that lives there.

    The nodes outside a bucket's largest component ask. A bucket of up to BLOCK nodes is one group. The nodes of a larger
    one are cut into cells of about BLOCK by whether they ask, by set size and by a hash, and every two cells whose sizes
    allow a link and of which one asks are a group. So a group holds about two cells, whatever the bucket holds.
    """
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("parts"))
    mixed = settle(sizes.filter("parts > 1").select("key", "main", (F.col("m") > BLOCK).alias("large")))
    rows = settle(named.join(mixed, "key").select("key", "node", "label", "large", (F.col("label") != F.col("main")).alias("asks")))
    columns = ["key", "part", "node", "label", "asks", "lives"]
    small = rows.filter("not large").withColumns({"part": F.lit(""), "lives": F.lit(True)}).select(columns)
    # linked sets differ by a factor of 100 / percent at most, which is one step of this size (with room for rounding)
    step = max(float(np.log(100 / percent)), 1e-6) * (1 + 1e-6)
    sized = rows.filter("large").join(known.select("node", "n"), "node").withColumn("size", F.floor(F.log("n") / step))
    cells = settle(sized.groupBy("key", "asks", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")))
    of = lambda side: cells.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("asks", "size", "cuts")])
    allowed = F.col("asks_a") & (F.abs(F.col("size_a") - F.col("size_b")) <= 1) & (~F.col("asks_b") | (F.col("size_a") <= F.col("size_b")))
    meet = settle(of("a").join(of("b"), "key").filter(allowed).withColumn("same", F.col("asks_b") & (F.col("size_a") == F.col("size_b"))))
    own = lambda cuts: F.pmod(F.xxhash64("node"), F.col(cuts)).cast("int")
    all_of = lambda cuts: F.sequence(F.lit(0), F.col(cuts) - 1)
    part = F.concat_ws(":", "size_a", "cut_a", "asks_b", "size_b", "cut_b")

    def side(name: str, own_cut: str, other: str, other_cut: str) -> DataFrame:
        met = sized.join(meet.withColumnRenamed("key", "in"), (F.col("key") == F.col("in")) & (F.col("asks") == F.col(f"asks_{name}")) & (F.col("size") == F.col(f"size_{name}")))
        return met.withColumn(own_cut, own(f"cuts_{name}")).withColumn(other_cut, F.explode(all_of(f"cuts_{other}")))

    # two cells of one kind meet once; a cell that meets itself has rows that ask and live
    left = side("a", "cut_a", "b", "cut_b").filter("not same or cut_a <= cut_b")
    left = left.select("key", part.alias("part"), "node", "label", F.lit(True).alias("asks"), F.expr("same and cut_a = cut_b").alias("lives"))
    right = side("b", "cut_b", "a", "cut_a").filter("not same or cut_a < cut_b")
    right = right.select("key", part.alias("part"), "node", "label", F.lit(False).alias("asks"), F.lit(True).alias("lives"))
    dealt = small.unionByName(left).unionByName(right)
    return dealt.join(known, "node").select(*columns, "n", "sketch", "bitmap")


def across_components(named: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that share a bucket and may reach the threshold, from rows (key, node, label)."""

    def compare(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(block)
        node, label, asks, lives = (t.column(i).to_numpy() for i in range(2, 6))
        own = Profiles(*(t.column(i).combine_chunks() for i in range(6, 9)))
        data, found = np.flatnonzero(lives), []
        keys = np.array([band_keys(x) for x in own.sketch])
        for q in np.flatnonzero(asks):
            y = data[label[data] != label[q]]
            x = np.full(len(y), q)
            # only in the first band that the two share
            first = (keys[x] == keys[y]).argmax(axis=1)
            ok = keys[q][first] == t.column(0)[0].as_py()
            x, y = x[ok], y[ok]
            near = own.near(x, own, y, percent)
            found.append(np.column_stack([node[x[near]], node[y[near]]]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, part = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                this = (key[s], part[s])
                if held and this != last:
                    yield compare(held)
                    held = []
                held.append(b.slice(s, e - s))
                last = this
        if held:
            yield compare(held)

    dealt = in_groups(named, known, percent).repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with ``100 * intersection >= percent * union`` on the full sets."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("members").alias(f"m_{side}"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "m_a", "m_b")
    return map_batches(both, batch, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each input row.

    Documents are linked if their sets of ``words``-word shingles (A-Z lower-cased) have a similarity of ``percent``/100
    or more; ``component_id`` is the smallest id reachable over links, and the document of that id is kept. Null and
    empty texts are linked with nothing. Rows with equal ids count as one document. Rows with a null id join the
    component of an equal set, if there is one with an id, and are otherwise alone (component null, kept). An empty
    table gives an empty result.
    """
    docs = two_columns(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = settle(sketched(docs, words))
    own = rows.filter("digest is not null").groupBy("digest")
    nodes = settle(own.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    placed = nodes.filter("node is not null")
    member = buckets(placed)
    hubs = member.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("hub")).filter("members > 1").select("key", "hub")
    shared = settle(member.join(settle(hubs), "key"))  # buckets with two nodes or more
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = settle(full_sets(docs.join(wanted, "doc_id", "left_semi"), words).dropDuplicates(["node"]))

    known = settle(profiles(sets))

    stars = shared.filter("node != hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("bands"))
    near = plausible(stars.select("a", "b"), known, percent)
    stars = settle(near.join(stars, ["a", "b"]))
    closest = stars.groupBy("b").agg(F.max_by("a", F.struct("bands", "a")).alias("a"))
    links = settle(confirmed(closest.select("a", "b"), sets, percent))
    labels = connect(links)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"))
    apart = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")
    links = settle(links.unionByName(confirmed(apart, sets, percent)))
    labels = connect(links)
    named = settle(shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    labels = connect(settle(links.unionByName(confirmed(across_components(named, known, percent), sets, percent))))

    found = nodes.join(labels, "node", "left").select(F.col("digest").alias("of"), F.coalesce("label", "node").alias("component"))
    return (
        rows.join(settle(found), F.col("digest") == F.col("of"), "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` with one document of each group of near duplicates left, the one with the smallest id.

    Of rows with equal ids one stays, of rows with null ids one for each text. Null and empty texts stay. Other columns
    may have any name. Only texts that may go travel. An empty table gives an empty result.
    """
    docs = two_columns(df, id_col, text_col)
    verdicts = settle(near_duplicates(df, id_col, text_col, words, percent))
    gone = verdicts.filter("doc_id is not null and not kept").select("doc_id").distinct()
    twice = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1").select("doc_id")
    known = settle(gone.withColumn("gone", F.lit(True)).unionByName(twice.filter("doc_id is not null").withColumn("gone", F.lit(False))))
    doubtful = probably_in(known.select("doc_id"))
    key = column(id_col).cast("long")
    named, unnamed = df.filter(key.isNotNull()), df.filter(key.isNull())
    taken = {c.lower() for c in df.columns}
    gone_id = next(name for name in (f"gone_id_{i}" for i in range(len(taken) + 1)) if name not in taken)
    out = known.filter("gone").select(F.col("doc_id").alias(gone_id))
    checked = named.filter(doubtful(key)).join(out, key == F.col(gone_id), "left_anti").dropDuplicates([id_col])
    return named.filter(~doubtful(key)).unionByName(checked).unionByName(unnamed.dropDuplicates([text_col]))
