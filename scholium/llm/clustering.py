"""Centroid clustering over integer vectors, with Hamerly's bounds.

Each vector carries its centroid's number and two bounds that stand in the table between rounds: an upper one of the
distance to its centroid and a lower one of the distance to the second nearest. When centroids move, the upper bound
grows by its centroid's drift and the lower shrinks by the largest drift of the others. While the upper bound stays
under the lower, or under half the way from the centroid to its nearest neighbour, the centroid is the only nearest
one. Otherwise the upper bound is measured; vectors that stay ambiguous get a full scan of all centroids in whole numbers,
so ties are seen and go to the smaller number. Bounds are rounded outwards.

A round is one pass over the table without a shuffle of vectors, and sums per cluster that are added up before they are
shuffled, so a cluster with most of the rows is one row of each task. Sixteen centroids and their sums come to the driver.

Defined cases: vectors of another length, without a value, or with a null, NaN or infinite component are left out; so is
a null vector. Repeated rows count as often as they stand there; repeated ids are told apart by their vectors, and a null
id is hashed as the empty string. Fewer vectors than clusters give as many centroids as vectors. Equal centroids: the
smaller number takes all. An empty table gives an empty result; other columns are ignored. A component whose integer
reaches 2^27 in size raises an error, as the distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import materialize, release, table

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Integers below this keep squared distances of 64 components within a long.
LARGEST = 1 << 27
#: Wider than the rounding of a square root and two sums.
_UP, _DOWN = 1 + 2.0**-48, 1 - 2.0**-48
STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, scanned boolean"


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that count, as integers."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter((F.size("e") == dim) & F.forall("e", whole))
    integer = lambda x: F.when(
        F.abs(F.floor(scale * x)) < LARGEST, F.floor(scale * x).cast("long")
    ).otherwise(F.raise_error(F.lit("a component is too large for whole-number distances")).cast("long"))
    return rows.select("vec_id", F.transform("e", integer).alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.orderBy(name, "v").limit(clusters).collect()], np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows ``x`` to one centroid, or to one centroid each."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, and bounds of the distances to it and to the second nearest, by whole numbers."""
    every = np.stack([_squared(x, c) for c in centroids], axis=1)
    nearest = every.argmin(axis=1)
    upper = np.sqrt(every[np.arange(len(x)), nearest].astype(np.float64)) * _UP
    if len(centroids) == 1:
        return nearest, upper, np.full(len(x), np.inf)
    lower = np.sqrt(np.partition(every, 1, axis=1)[:, 1].astype(np.float64)) * _DOWN
    return nearest, upper, lower


class Move:
    """What the vectors need to know of centroids that have moved."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.after = after
        self.drift = np.sqrt(_squared(before, after).astype(np.float64)) * _UP
        k = len(after)
        self.others = np.array([max([0.0, *(self.drift[j] for j in range(k) if j != i)]) for i in range(k)])
        between = np.sqrt(np.stack([_squared(after, c) for c in after]).astype(np.float64)) * _DOWN
        np.fill_diagonal(between, np.inf)
        self.half = between.min(axis=1) / 2

    def apply(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """New cluster, upper and lower bounds, and which vectors had a full scan."""
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * _UP
        lower = lower - self.others[cluster]
        lower = np.where(lower > 0, lower * _DOWN, 0.0)
        wall = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= wall)
        upper[open_] = np.sqrt(_squared(x[open_], self.after[cluster[open_]]).astype(np.float64)) * _UP
        open_ = open_[upper[open_] >= wall[open_]]
        scanned = np.zeros(len(x), bool)
        scanned[open_] = True
        cluster[open_], upper[open_], lower[open_] = scan(x[open_], self.after)
        return cluster, upper, lower, scanned


def _batch(ids: pa.Array, v: pa.Array, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: np.ndarray) -> pa.RecordBatch:
    columns = [ids, v, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "scanned"])


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The table of bounds after a first full scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _batch(b.column(0), b.column(1), *scan(_matrix(b.column(1), centroids.shape[1]), centroids), np.ones(b.num_rows, bool))

    return rows.mapInArrow(run, STATE)


def moved(state: DataFrame, move: Move) -> DataFrame:
    """The table of bounds after the centroids moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = [b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
                yield _batch(b.column(0), b.column(1), *move.apply(_matrix(b.column(1), move.after.shape[1]), *held))

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("decimal(20, 0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return out


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = centroids[b.column(2).to_numpy(zero_copy_only=False)]
                far = pa.array(_squared(_matrix(b.column(1), centroids.shape[1]), own))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), far], names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def final_state(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The table of bounds after the last assignment, and the centroids it belongs to."""
    state = materialize(assigned(rows, centroids), "cluster-state")
    for _ in range(rounds):
        new = means(state, centroids)
        after = materialize(moved(state, Move(centroids, new)), "cluster-state")
        release(rows.sparkSession, state)
        state, centroids = after, new
    return state, centroids


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per vector its cluster and squared distance, its cluster's and the whole inertia and the digest of its centroid."""
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, dim, scale), "cluster-vectors")
    start = first_centroids(rows, k, seed)
    if not len(start):
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], none)
    state, centroids = final_state(rows, start, rounds)
    out = materialize(_distances(state, centroids), "cluster-distances")
    per = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    lines = [(c, s, sum(per.values()), digest(centroids[c])) for c, s in sorted(per.items())]
    named = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )  # a row for each cluster, ``k`` at most


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    return f"""
a{n} AS (SELECT rid, min({{'d': d, 'c': c}}) AS b FROM (
  SELECT x.rid, k.c, sum((x.x - k.x) * (x.x - k.x)) AS d FROM x JOIN k{n} AS k ON k.i = x.i GROUP BY x.rid, k.c) GROUP BY rid),
k{n + 1} AS (SELECT k.c, k.i, coalesce((s - ((s % n) + n) % n) // n, k.x) AS x FROM k{n} AS k LEFT JOIN (
  SELECT a.b.c AS c, x.i, sum(x.x)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} AS a ON a.rid = x.rid GROUP BY a.b.c, x.i) AS m ON m.c = k.c AND m.i = k.i)"""


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
x AS (SELECT rid, unnest(range(1, {DIM + 1})) AS i, unnest(v) AS x FROM kept),
s AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
  SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS})),
k0 AS (SELECT c, unnest(range(1, {DIM + 1})) AS i, unnest(v) AS x FROM s),
{",".join(_round(n) for n in range(ROUNDS + 1))},
d AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM k{ROUNDS} GROUP BY c)
SELECT vec_id, a.b.c::INTEGER AS cluster, a.b.d::BIGINT AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.c))::BIGINT AS cluster_inertia,
  (sum(a.b.d) OVER ())::BIGINT AS inertia, d.h AS centroid_sha256
FROM kept JOIN a{ROUNDS} AS a ON a.rid = kept.rid JOIN d ON d.c = a.b.c
"""
