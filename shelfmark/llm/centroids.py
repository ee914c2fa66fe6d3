"""Centroid clustering: whole-number k-means whose bounds are loosened by geometry, not by full drift.

Each vector keeps an upper bound of the distance to its own centroid and one lower bound of the distance to all
others. When centroids move:

1. A cluster's vectors lie in a sphere around the old centroid, with the largest upper bound as radius. For each
   other centroid, the plane through the sphere's centre and the line of its move shows how much nearer to it any
   vector of the sphere can have come: seen from the middle of the move, a hyperbola of equal gains lies inside its
   asymptotes, so the gain is at most the drift times the cosine of the smallest angle that the sphere is seen at.
   Seen from where the move began, that holds as well and also for losses. The smaller of both is taken.
2. The lower bound of a cluster's vectors goes down by the largest of these gains, which is less than the largest
   drift; the upper bound goes up by the drift of their own centroid.
3. A vector whose upper bound is below its lower bound, or below half the way from its centroid to the next one, stays.
   If not, the upper bound is made exact; vectors that are still ambiguous are scanned against all centroids, in
   whole numbers.

A round is one pass: tasks read the table of vectors and bounds and write the next one, with a row per task and
cluster that holds the cluster's sums. The sums are added up in a shuffle of k rows a task. Only centroids, sums and
radii, k rows of each, come to the driver; no cluster is ever gathered. Each table is complete before it is read.

Components become floor(scale * x). Vectors that are null, have another number of components than ``dim``, or hold a
null or non-finite one take no part, nor do those with a scaled component beyond 2^27, as their squared distances
don't fit a long. Rows that repeat are vectors of their own, and start as centroids of their own if their hash says so;
a null vec_id is hashed as an empty one, and rows of equal hashes are ordered by vector. With fewer vectors than ``k``
there are fewer centroids; without vectors there are no rows. A sum of distances beyond a long is null. Columns other
than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

#: Scaled components beyond this take no part.
LARGEST = 1 << 27
#: Products of whole numbers up to this are exact in doubles for any number of components that fits a task.
_EXACT = 1 << 20
_STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, sums array<long>"


def scaled(vector: Column, dim: int, scale: int) -> Column:
    """``array<int>`` of floor(scale * x); null where the vector takes no part."""
    wide = vector.cast("array<double>")
    fits = F.forall(
        wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(x * scale).cast("double").between(-LARGEST, LARGEST))
    )
    # a double beyond a long is cut to the largest one by floor, so it fails the test as well
    return F.when((F.size(wide) == dim) & F.coalesce(fits, F.lit(False)), F.transform(wide, lambda x: F.floor(x * scale).cast("int")))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT and x.shape[1] <= 1024:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, centroid in enumerate(c.astype(np.int64)):
        out[:, j] = ((x - centroid) ** 2).sum(axis=1)
    return out


def gain(centre: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray) -> float:
    """The most by which a vector of the sphere can come nearer to a centroid that moves."""
    move = after - before
    drift = float(np.sqrt((move * move).sum()))
    if drift == 0.0:
        return 0.0

    def steepest(apex: np.ndarray) -> float:
        """Cosine of the smallest angle between the move and a ray from ``apex`` to the sphere."""
        ray = centre - apex
        length = float(np.sqrt((ray * ray).sum()))
        if length <= radius:
            return 1.0
        angle = np.arccos(np.clip(float(ray @ move) / (length * drift), -1.0, 1.0))
        return float(np.cos(max(angle - np.arcsin(radius / length), 0.0)))

    return drift * min(max(steepest((before + after) / 2), 0.0), steepest(before))


def loosened(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster, the drift of its centroid and the most that any other came nearer to its vectors."""
    a, b = before.astype(np.float64), after.astype(np.float64)
    drift = np.sqrt(((b - a) ** 2).sum(axis=1))
    most = np.full(len(a), -np.inf)
    for i in range(len(a)):
        if radii[i] < 0:
            continue  # no vectors
        # the largest drifts first: none of those after the largest gain so far can exceed it
        for j in np.argsort(-drift):
            if drift[j] <= most[i]:
                break
            if i != j:
                most[i] = max(most[i], gain(a[i], radii[i], a[j], b[j]))
    return drift, np.where(np.isfinite(most), most, 0.0)


def half_ways(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the next one."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    d = np.sqrt(squared(c, c).astype(np.float64))
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1) / 2


def _slack(values: np.ndarray) -> np.ndarray:
    """Room for rounding in bounds."""
    return 1e-9 * (1.0 + np.abs(values))


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance, and the distance to the second."""
    d = squared(x, c)
    at = d.argmin(axis=1)  # the first of equals, so the smaller number
    rows = np.arange(len(x))
    own = d[rows, at]
    if len(c) == 1:
        return at, own, np.full(len(x), np.inf)
    d[rows, at] = np.iinfo(np.int64).max
    return at, own, np.sqrt(d.min(axis=1).astype(np.float64))


def assign(
    x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, half: np.ndarray
) -> int:
    """Bring clusters and bounds up to date in place; the number of vectors that were scanned."""
    least = np.maximum(lower, half[cluster])
    near = np.flatnonzero(upper + _slack(upper) >= least - _slack(least))
    if not len(near):
        return 0
    own = ((x[near].astype(np.int64) - c[cluster[near]]) ** 2).sum(axis=1)
    upper[near] = np.sqrt(own.astype(np.float64))
    left = near[upper[near] + _slack(upper[near]) >= least[near] - _slack(least[near])]
    if len(left):
        cluster[left], own, lower[left] = scan(x[left], c)
        upper[left] = np.sqrt(own.astype(np.float64))
    return len(left)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sum_rows(sums: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
    """A row per cluster with vectors: their number and sums, and the largest upper bound."""
    held = np.flatnonzero(sums[:, 0])
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(held.astype(np.int32)),
            pa.array(reach[held]), pa.nulls(n, pa.float64()),
            pa.array(list(sums[held]), pa.list_(pa.int64())),
        ],
        names=["vec_id", "v", "cluster", "upper", "lower", "sums"],
    )


def _pass(rows: DataFrame, dim: int, c: np.ndarray, moved: tuple[np.ndarray, np.ndarray] | None, path: str) -> DataFrame:
    """Write the next table: ``moved`` holds drifts and gains since the bounds of ``rows``, None on the first pass."""
    half = half_ways(c)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, reach = np.zeros((len(c), dim + 1), np.int64), np.zeros(len(c))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            if moved is None:
                cluster, own, lower = scan(x, c)
                upper = np.sqrt(own.astype(np.float64))
            else:
                cluster, upper, lower = (batch.column(i).to_numpy().copy() for i in (2, 3, 4))
                drift, gains = moved
                upper = upper + drift[cluster]
                lower = lower - gains[cluster]
                assign(x, cluster, upper, lower, c, half)
            np.maximum.at(reach, cluster, upper)
            order = np.argsort(cluster, kind="stable")
            kinds, firsts = np.unique(cluster[order], return_index=True)
            sums[kinds, 1:] += np.add.reduceat(x[order].astype(np.int64), firsts, axis=0)
            sums[kinds, 0] += np.diff(np.append(firsts, len(order)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper),
                    pa.array(lower), pa.nulls(n, pa.list_(pa.int64())),
                ],
                names=["vec_id", "v", "cluster", "upper", "lower", "sums"],
            )
        yield _sum_rows(sums, reach)

    rows.mapInArrow(step, _STATE).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _moved(table: DataFrame, c: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The next centroids and the radii of the spheres (-1: no vectors)."""
    parts = table.filter("sums is not null").select("cluster", "upper", F.posexplode("sums").alias("i", "s"))
    told = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("upper").alias("r"))
    after, radii, counts = c.copy(), np.full(len(c), -1.0), {}
    rows = told.collect()  # k * (dim + 1) of them
    for r in rows:
        if r["i"] == 0:
            counts[r["cluster"]] = int(r["s"])
            radii[r["cluster"]] = r["r"]
    for r in rows:
        if r["i"] > 0:
            after[r["cluster"], r["i"] - 1] = int(r["s"]) // counts[r["cluster"]]
    return after, radii


def cluster(
    table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector.

    Centroids start as the ``k`` vectors of the smallest sha256 of ``seed:vec_id``. Runs a job for each round.
    """
    spark = table.sparkSession
    vectors = table.select(
        F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), dim, scale).alias("v")
    ).filter("v is not null")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], kind)
    c = np.array([r["v"] for r in first], np.int64)
    path = scratch_path(spark, "centroids")
    state = _pass(vectors, dim, c, None, f"{path}/0")
    for i in range(rounds):
        after, radii = _moved(state, c, dim)
        drift, gains = loosened(c, after, radii)
        margin = 1e-7 * (1.0 + drift.max())  # for rounding in angles
        rows = state.filter("sums is null")
        c = after
        state = _pass(rows, dim, c, (drift + margin, gains + margin), f"{path}/{i + 1}")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column(1), dim).astype(np.int64), batch.column(2)
            d = ((x - c[at.to_numpy()]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), at, pa.array(d)], names=["vec_id", "cluster", "distance"])

    placed = state.filter("sums is null").select("vec_id", "v", "cluster")
    placed.mapInArrow(measure, "vec_id long, cluster int, distance long").write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    told = placed.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    inertia = {r["cluster"]: r["cluster_inertia"] for r in told.collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    whole = None if whole is None or whole >= 1 << 63 else whole
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    clusters = spark.createDataFrame(
        [(i, n, whole, digests[i]) for i, n in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
