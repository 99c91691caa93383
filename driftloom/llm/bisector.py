"""Centroid clustering by a bisector tournament, in integers.

Every vector becomes integers, so sums, means and distances are exact and no order of work changes a result. The set of
points as near to centroid i as to centroid j is a plane: ``2 (c_j - c_i) x = |c_j|^2 - |c_i|^2``. Its normal and
threshold are computed once a round for each pair of centroids. A vector then plays a tournament: the first champion is
centroid 0, and each of the other k - 1 centroids meets the champion in one linear test whose sign says who goes on;
zero favours the smaller number. Only the distance to the winner is computed.

A round is one pass over the vectors: a task adds up what it has per cluster and hands on k rows, their sums are taken
on the executors, and k sums reach the driver. No vector moves after it has been read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.text import column
from driftloom.session import settle

CLUSTERS, ROUNDS, SCALE, DIMENSIONS = 8, 10, 1024, 64
#: The centroids start at the vectors whose ids have the smallest hashes with this seed.
SEED = 3
#: Vectors of a task that are in a tournament at once.
ROWS = 4096


def largest(dimensions: int) -> int:
    """Integers up to this size: each test and each distance of that many of them fits 64 bits."""
    return min(isqrt(2**63 // (5 * max(dimensions, 1))), 2**31 - 1)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``vec_id, x``: the vectors of the right length without null or non-finite components, as integers."""
    v, most = F.col("v"), float(largest(dimensions))
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = df.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).alias("v"))
    rows = rows.filter(F.coalesce((F.size(v) == dimensions) & finite, F.lit(False)))
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(most)), F.lit(-most))).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; rows without an id come last, equal ones in the order of their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.x for r in rows.orderBy(name.asc_nulls_last(), "x").limit(clusters).collect()]


class Tournament:
    """Normals and thresholds for every pair of centroids, and who wins."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        square = (self.centroids**2).sum(axis=1)
        self.normal = 2 * (self.centroids[None] - self.centroids[:, None])
        self.threshold = square[None] - square[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row of ``x``."""
        champion = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", self.normal[champion, rival], x) - self.threshold[champion, rival]
            champion = np.where(side > 0, rival, champion)
        return champion

    def distances(self, x: np.ndarray, winner: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[winner]) ** 2).sum(axis=1)


def matrices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            yield part, part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floor of each cluster's mean, and empty clusters as they are."""
    tournament, dimensions = Tournament(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64)
        for _, x in matrices(batches, dimensions):
            winner = tournament.winners(x)
            for c in np.unique(winner):
                n[c] += (winner == c).sum()
                total[c] += x[winner == c].sum(axis=0)
        met = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * dimensions, pa.int32()), pa.array(total[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), sums], ["cluster", "n", "total"])

    parts = rows.mapInArrow(run, "cluster long, n long, total array<long>")
    cells = parts.select("cluster", "n", F.posexplode("total").alias("at", "x"))
    sums = cells.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # clusters times dimensions
        out[r.cluster][r["at"]] = int(r.s) // r.n
    return out


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    tournament = Tournament(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, len(centroids[0])):
            winner = tournament.winners(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(winner, pa.int32()), pa.array(tournament.distances(x, winner))], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` (squared), one row for each vector that is kept, and the final centroids.

    A vector is kept if it has ``dimensions`` components, none null or non-finite; a component x counts as
    ``floor(scale * x)``, held within ``largest(dimensions)`` so that distances fit 64 bits. Equal distances go to the
    smaller number, a cluster without vectors keeps its centroid. With fewer vectors than clusters each starts one.
    Rows with equal ids count as vectors of their own; rows with a null id are clustered like others and start a
    cluster only when there are too few others. Other columns of the input, whatever their names, are not read. Without
    any vector the result is empty and there are no centroids.
    """
    rows = settle(whole_vectors(df, id_col, vector_col, dimensions, scale))
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        before, centroids = centroids, moved(rows, centroids)
        if centroids == before:  # no vector changes its cluster any more
            break
    return assigned(rows, centroids), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options: int) -> DataFrame:
    """``cluster_vectors`` with ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256``."""
    found, centroids = cluster_vectors(df, id_col, vector_col, **options)
    found = settle(found)
    # a row per cluster at most; sums that don't fit 64 bits are null
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per_cluster = [(c, sums.get(c, 0), centroid_digest(x)) for c, x in enumerate(centroids)] or [(0, 0, "")]
    fit = lambda n: F.lit(n if n < 2**63 else None).cast("long")
    of = lambda at: F.element_at(F.array(*[fit(row[at]) if at == 1 else F.lit(row[at]) for row in per_cluster]), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", of(1).alias("cluster_inertia"), fit(sum(sums.values())).alias("inertia"), of(2).alias("centroid_sha256"))


def sql(dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same by distances to every centroid, for small tables."""
    nearest = """SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d)::BIGINT AS distance FROM (
        SELECT row, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(x, c)])::BIGINT AS d FROM v, {c}) GROUP BY row"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
            SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
              SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (row), range(1, {dimensions + 1}) t(i) GROUP BY cluster, i
            ) GROUP BY cluster) m ON m.cluster = c{r}.cluster)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor(e::DOUBLE * {scale})::BIGINT for e in embedding] AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e::DOUBLE)]) = {dimensions}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), x) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {clusters}
), {", ".join(steps)}, final AS MATERIALIZED ({nearest.format(c=f"c{rounds}")})
SELECT v.vec_id, f.cluster::INT AS cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
  (sum(f.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM v JOIN final f USING (row) JOIN c{rounds} c ON c.cluster = f.cluster
"""
