"""Clusters of vectors around centroids, by Drake's adaptive bounds on distances."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.llm.common import shared_dir
from ledgertide.working import discard, stored_at

CENTROIDS, ROUNDS, SIZE, SCALE = 40, 5, 64, 256
#: Components beyond this are refused: squared distances of vectors of 64 of them still fit a long.
LARGEST = 1 << 27
#: Bounds are kept away from what floating point may round off.
UP, DOWN = 1 + 1e-9, 1 - 1e-9
#: Vectors whose distances are taken together.
BLOCK = 4096


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x from each row of c; both hold integers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # then every sum is exact in floating point
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _to_some(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x from its own choice of rows of c."""
    d = x[:, None, :] - c[which]
    return (d * d).sum(axis=2)


class Bounds:
    """For each vector its centroid, an upper bound of the distance to it, the next nearest centroids in order with a lower bound
    each, and one lower bound more for all the rest. Every lower bound also holds for what comes after it."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray):
        self.cluster, self.upper, self.near, self.lower = cluster, upper, near, lower
        #: How many bounds did not certify the order, of each vector.
        self.used = np.zeros(len(cluster), dtype=np.int32)

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, keep: int) -> Bounds:
        """By distances from all centroids; of equal ones the smaller number comes first."""
        d = squared(x, c)
        order = np.argsort(d, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
        rest = far[:, keep + 1] if keep + 1 < len(c) else np.full(len(x), np.inf)
        lower = np.column_stack([far[:, 1 : keep + 1], rest]) * DOWN
        return cls(order[:, 0].astype(np.int32), far[:, 0] * UP, order[:, 1 : keep + 1].astype(np.int32), lower)

    def moved(self, drift: np.ndarray, keep: int) -> None:
        """After each centroid has moved by its drift; of the bounds the first `keep` stay apart."""
        self.upper = (self.upper + drift[self.cluster]) * UP
        self.lower[:, :-1] -= drift[self.near]
        self.lower[:, -1] -= drift.max(initial=0.0)
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]
        self.lower = self.lower[:, : keep + 1] * np.where(self.lower[:, : keep + 1] > 0, DOWN, UP)
        self.near = self.near[:, :keep]

    def settle(self, x: np.ndarray, c: np.ndarray) -> None:
        """Makes each vector's centroid the nearest, looking only at those that bounds don't exclude."""
        keep = self.near.shape[1]
        open_ = np.flatnonzero(self.upper >= self.lower[:, 0])
        self.upper[open_] = np.sqrt(_to_some(x[open_], c, self.cluster[open_, None])[:, 0].astype(np.float64)) * UP
        doubt = (self.upper[:, None] >= self.lower).sum(axis=1)
        doubt[self.upper < self.lower[:, 0]] = 0
        self.used = doubt.astype(np.int32)
        for n in range(1, keep + 1):  # the order among the first n is uncertain, all others are farther than the centroid
            rows = np.flatnonzero(doubt == n)
            if len(rows):
                which = np.column_stack([self.cluster[rows], self.near[rows, :n]])
                d = _to_some(x[rows], c, which)
                order = np.lexsort((which, d), axis=1)
                which, far = np.take_along_axis(which, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
                self.cluster[rows], self.upper[rows] = which[:, 0], far[:, 0] * UP
                self.near[rows, :n], self.lower[rows, :n] = which[:, 1:], far[:, 1:] * DOWN
        rows = np.flatnonzero(doubt > keep)
        if len(rows):
            again = Bounds.scanned(x[rows], c, keep)
            self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows] = again.cluster, again.upper, again.near, again.lower


_STATE = "id {}, x array<long>, cluster int, upper double, near array<int>, lower array<double>, used int, distance long"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 0))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), type=kind))


def _assigned(rows: DataFrame, c: np.ndarray, keep: int, drift: np.ndarray | None) -> DataFrame:
    """rows (id, x, and bounds if drift tells how centroids have moved since) with bounds for the centroids c."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n = batch.num_rows
                x = _matrix(batch.column("x"), n)
                if drift is None:
                    b = Bounds.scanned(x, c, keep)
                else:
                    near = batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).copy()
                    b = Bounds(batch.column("cluster").to_numpy().copy(), batch.column("upper").to_numpy().copy(), near, _matrix(batch.column("lower"), n).copy())
                    b.moved(drift, keep)
                    b.settle(x, c)
                distance = _to_some(x, c, b.cluster[:, None])[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("x"), pa.array(b.cluster, type=pa.int32()), pa.array(b.upper), _lists(b.near, pa.int32()), _lists(b.lower, pa.float64()), pa.array(b.used, type=pa.int32()), pa.array(distance, type=pa.int64())],
                    names=["id", "x", "cluster", "upper", "near", "lower", "used", "distance"],
                )

    return rows.mapInArrow(run, _STATE.format(id_type))


def _means(rows: DataFrame, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The floors of the clusters' means, empty ones as they were, and the most bounds that a vector needed.

    A task adds up its own vectors, so each sends one row for a cluster at most, and the driver gets the centroids' components.
    """
    k, size = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, used = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64), 0
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy()
                np.add.at(sums, cluster, _matrix(batch.column("x"), batch.num_rows))
                n += np.bincount(cluster, minlength=k)
                used = max(used, int(batch.column("used").to_numpy().max()))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, type=pa.int32()), pa.array(n[held]), _lists(sums[held], pa.int64()), pa.array(np.full(len(held), used, dtype=np.int32))], names=["cluster", "n", "sums", "used"])

    parts = rows.select("x", "cluster", "used").mapInArrow(run, "cluster int, n long, sums array<long>, used int")
    flat = parts.select("cluster", "n", "used", F.posexplode("sums").alias("at", "part"))
    exact = lambda x: F.sum(F.col(x).cast("decimal(38,0)")).alias(x)
    out, most = c.copy(), 0
    for r in flat.groupBy("cluster", "at").agg(exact("n"), exact("part"), F.max("used").alias("used")).collect():  # centroids times components
        out[r["cluster"], r["at"]] = int(r["part"]) // int(r["n"])
        most = max(most, r["used"])
    return out, most


def cluster(vectors: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, x, cluster, distance), centroids) of integer vectors (id, x), after `rounds` of assigning and moving, starting at `first`.

    In each round every vector goes to the nearest centroid (squared distance; of equal ones the smaller number), then each
    centroid that has vectors moves to the floor of their mean. Bounds are kept beside the vectors in a table for each round, of
    which the last two exist at a time. A quarter of the centroids have bounds of their own at first; afterwards as many as any vector needed in the
    round before, an eighth at least. Distances are exact integers, so the result does not depend on the bounds.

    The centroids are on the driver and in each task: their number is a parameter. Vectors stay in the partitions they are
    read in; nothing is shuffled but the sums.
    """
    spark, k = vectors.sparkSession, len(first)
    c, keep = first.astype(np.int64), min(k - 1, max(1, k // 4))
    path = shared_dir(spark, "clusters")
    state = stored_at(_assigned(vectors, c, keep, None), path)
    for _ in range(rounds):
        new, used = _means(state, c)
        drift = np.sqrt(((new - c).astype(np.float64) ** 2).sum(axis=1)) * UP
        c, keep = new, min(keep, max(1, k // 8, used))
        after = shared_dir(spark, "clusters")
        state = stored_at(_assigned(state, c, keep, drift), after)
        discard(spark, path)
        path = after
    return state.select("id", "x", "cluster", "distance"), c


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE) -> DataFrame:
    """(id, x) of the vectors of `size` finite components; x holds floor(SCALE * component). Components whose result is beyond
    LARGEST are an error, as distances would not fit a long."""
    parts = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    fine = rows.select(F.col(id_col).alias("id"), parts.alias("e")).where((F.size("e") == size) & ~F.exists("e", bad))
    too_large = F.raise_error(F.lit(f"a component times {SCALE} is beyond {LARGEST}")).cast("long")
    return fine.select("id", F.transform("e", lambda e: F.when(F.abs(e * SCALE) <= LARGEST, F.floor(e * SCALE)).otherwise(too_large)).alias("x"))


def first_centroids(vectors: DataFrame, n: int = CENTROIDS) -> np.ndarray:
    """The vectors of the n smallest hashes of `2:<id>`, in that order; without an id they come last, equal ids by their components."""
    key: Column = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(n).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def clustered(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE, n: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of `size` finite components.

    Vectors with null or non-finite components or of another length are left out. With fewer than n vectors there are as many
    centroids as vectors. Repeated rows and rows without an id count each. An empty table gives an empty one, and other columns,
    whatever their names, have no effect.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vec_col, size)
    first = first_centroids(vectors, n)
    id_type = rows.schema[id_col].dataType.simpleString()
    if not len(first):
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found, c = cluster(vectors, first, rounds)
    sums = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # a row for each centroid
    sha = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    known = spark.createDataFrame([(k, sums[k], sum(sums.values()), sha(c[k])) for k in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(known), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each whole vector of embeddings: 40 centroids, 5 rounds. Odd rows as in clustered()."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rounds in SQL: a step for each assignment and each move of the centroids."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {CENTROIDS}))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, min({{'d': d, 'k': k}}) AS best FROM
  (SELECT rid, k, CAST(list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v, c{r} c) GROUP BY rid)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM
  (SELECT best.k AS k, i, sum(v.x[i]) AS s, count(*) AS n FROM v JOIN a{r} USING (rid), range(1, {SIZE + 1}) t(i) GROUP BY 1, 2) GROUP BY k) m USING (k))""")
    last = f"""SELECT v.vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256 FROM v JOIN a{ROUNDS} USING (rid) JOIN c{ROUNDS} ON c{ROUNDS}.k = best.k"""
    return "WITH " + ",\n".join(steps) + "\n" + last


OP11_SQL = _sql()
