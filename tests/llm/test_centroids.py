"""Centroid clustering against plain k-means in whole numbers, and its bounds against sampled spheres."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import centroids

COLUMNS = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()


def brute(rows, k, rounds, dim, scale=256, seed=2):
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != dim or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(scale * float(np.float32(x)))) for x in v]
        if max(map(abs, whole)) <= centroids.LARGEST:
            kept.append((vec_id, whole))
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c[j] for j in range(len(c))]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, j, d, fits(inertia[j]), fits(total), digest[j]) for i, d, j in found]


def check(spark, rows, k, rounds, dim):
    table = spark.createDataFrame(
        [(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string"
    )
    got = centroids.cluster(table.repartition(3), k=k, rounds=rounds, dim=dim)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, k, rounds, dim))


@pytest.mark.parametrize("k, rounds, spread", [(7, 5, 0.2), (12, 8, 1.0), (1, 3, 0.5), (40, 2, 0.05)])
def test_same_as_plain_k_means(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(9, 6))
    x = middles[rng.integers(0, 9, 300)] + spread * rng.normal(size=(300, 6))
    check(spark, [(i, r.tolist()) for i, r in enumerate(x)], k, rounds, 6)


def test_odd_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]  # many ties
    rows += rows[:5] + [(3, [9.0, 9.0, 9.0, 9.0])]  # repeated ids, with equal and with other vectors
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [1.0] * 5)]
    rows += [(105, [float("inf"), 0.0, 0.0, 0.0]), (106, [3e38, 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(107, [4e5, 4e5, -4e5, 4e5]), (108, [-4e5, -4e5, 4e5, -4e5])]  # beyond exact doubles
    check(spark, rows, 8, 4, 4)


def test_sums_beyond_a_long_are_null(spark):
    far = [(i, [5e5 if i % 2 else -5e5] * 64) for i in range(40)]
    check(spark, far, 1, 1, 64)


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0])], 40, 3, 2)
    check(spark, [], 4, 2, 2)
    check(spark, [(1, None)], 4, 2, 2)


@pytest.mark.parametrize("dim", [2, 3, 64])
def test_gains_bound_all_vectors_of_a_sphere_below_the_drift(dim):
    rng = np.random.default_rng(dim)
    closer = 0
    for _ in range(300):
        centre, before = rng.normal(size=(2, dim))
        after = before + rng.normal(size=dim) * rng.choice([0.01, 0.3, 2.0])
        radius = rng.random() * rng.choice([0.05, 0.5, 3.0])
        bound = centroids.gain(centre, radius, before, after)
        ways = rng.normal(size=(400, dim))
        ways *= (radius * rng.random(400) ** (1 / dim) / np.linalg.norm(ways, axis=1))[:, None]
        ways[0] = 0.0
        x = centre + ways
        gained = np.linalg.norm(x - before, axis=1) - np.linalg.norm(x - after, axis=1)
        drift = np.linalg.norm(after - before)
        assert gained.max() <= bound + 1e-9 and bound <= drift + 1e-12
        closer += bound < 0.7 * drift
    assert closer > 100


def test_bounds_spare_most_scans():
    """On clustered vectors the later rounds scan few of them, fewer than with the full drift."""
    rng = np.random.default_rng(8)
    middles = rng.integers(-2000, 2000, (20, 16))
    x = (middles[rng.integers(0, 20, 4000)] + rng.integers(-300, 300, (4000, 16))).astype(np.int32)
    scanned = {}
    for way in ("tight", "drift"):
        c = x[:20].astype(np.int64)
        at, own, lower = centroids.scan(x, c)
        upper, scanned[way] = np.sqrt(own.astype(float)), 0
        for _ in range(6):
            radii = np.array([upper[at == j].max(initial=-1.0) for j in range(20)])
            after = np.array([x[at == j].sum(axis=0) // max((at == j).sum(), 1) if (at == j).any() else c[j] for j in range(20)])
            drift, gains = centroids.loosened(c, after, radii)
            if way == "drift":
                gains = np.full(20, drift.max())
            c, upper, lower = after, upper + drift[at] + 1e-6, lower - gains[at] - 1e-6
            scanned[way] += centroids.assign(x, at, upper, lower, c, centroids.half_ways(c))
            assert (at == centroids.squared(x, c).argmin(axis=1)).all()
    assert scanned["tight"] < scanned["drift"] < 6 * len(x)
