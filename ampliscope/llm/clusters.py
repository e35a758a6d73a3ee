"""Exact k-means on integer vectors; nearest centroids by annulus search.

Centroids are sorted by norm. A vector's distance to the centroid of the nearest norm bounds its least distance from above,
and a centroid can only be as near if its norm is within that bound of the vector's: two binary searches give the candidates, which
are compared exactly. Norms are rounded outwards, so centroids at the very edge, ties among them, are always compared.

A round reads the vectors once; tasks send the exact sums of their own clusters, and the driver holds centroids only."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved

K, ROUNDS, SCALE, DIMS, SEED = 8, 10, 1024, 64, 3
LIMB = 40  # bits; sums travel in limbs, so that none overflows
_SLACK = 1e-9


def kind_for(largest: int, dims: int) -> np.dtype:
    """Numbers in which squared distances of components up to largest are exact: doubles, longs, or Python's integers."""
    most = dims * (2 * largest) ** 2
    return np.dtype(np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: longs, or Python's integers where some are too large."""
    scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) < 1 << 53:
        return scaled.astype(np.int64)
    parts = [float(x).as_integer_ratio() for x in values.ravel()]
    return np.array([scale * a // b for a, b in parts], object).reshape(values.shape)


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1).astype(np.float64))


def _between(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the nearest centroid (ties: the smaller number), the squared distance, and how many distances were computed in all."""
    largest = max([int(np.abs(rows).max(initial=0)), *(abs(x) for c in centroids for x in c)])
    kind = kind_for(largest, rows.shape[1])
    rows, table = rows.astype(kind), np.array(centroids, object).astype(kind)
    norms, own = _norms(table), _norms(rows)
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    right = np.clip(np.searchsorted(norms, own), 1, len(norms) - 1) if len(norms) > 1 else np.zeros(len(rows), np.int64)
    left = np.maximum(right - 1, 0)
    start = np.where(np.abs(norms[left] - own) <= np.abs(norms[right] - own), left, right)
    best = order[start]
    least = _between(rows, table[best])
    computed = len(rows)
    bound = np.sqrt(least.astype(np.float64)) + _SLACK * (own + norms[-1] + 1)
    lo, hi = np.searchsorted(norms, own - bound, side="left"), np.searchsorted(norms, own + bound, side="right")
    for place, c in enumerate(order.tolist()):
        at = np.flatnonzero((lo <= place) & (place < hi) & (start != place))
        if len(at):
            d = _between(rows[at], table[c])
            better = (d < least[at]) | ((d == least[at]) & (c < best[at]))
            best[at[better]], least[at[better]] = c, d[better]
            computed += len(at)
    return best, least, computed


def _vectors(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1), scale)


def _limbs(sums: np.ndarray):
    """(place, limb, value) of the limbs of integers that are not zero; a limb has its integer's sign."""
    sign, size, limb = np.where(sums < 0, -1, 1), np.abs(sums), 0
    while (size > 0).any():
        low = size & ((1 << LIMB) - 1)
        for at in np.flatnonzero(low):
            yield int(at), limb, int(low[at]) * int(sign[at])
        size, limb = size >> LIMB, limb + 1


def _summer(centroids: list[list[int]], scale: int):
    """A mapInArrow function: (cluster, component, limb, value) sums of a task's vectors; component -1 counts them."""
    dims = len(centroids[0])

    def summed(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), object)
        for batch in batches:
            rows = _vectors(batch.column(0), scale)
            best = nearest(rows, centroids)[0]
            counts += np.bincount(best, minlength=len(centroids))
            wide = rows if len(rows) and int(np.abs(rows).max()) < 1 << 62 - len(rows).bit_length() else rows.astype(object)
            for c in np.unique(best).tolist():
                sums[c] += wide[best == c].sum(0).astype(object)
        out = [(int(c), -1, 0, int(counts[c])) for c in np.flatnonzero(counts)]
        out += [(at // dims, at % dims, limb, value) for at, limb, value in _limbs(sums.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "limb", "value"])

    return summed


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """The centroids after a round: exact floored means of their vectors; empty ones stay."""
    if not centroids:
        return centroids
    sums = vectors.select("vector").mapInArrow(_summer(centroids, scale), "cluster int, component int, limb int, value long")
    counts, totals = [0] * len(centroids), [[0] * len(c) for c in centroids]
    for r in sums.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # some rows a component
        if r["component"] < 0:
            counts[r["cluster"]] += int(r["value"])
        else:
            totals[r["cluster"]][r["component"]] += int(r["value"]) << LIMB * r["limb"] if r["value"] >= 0 else -(-int(r["value"]) << LIMB * r["limb"])
    return [[t // n for t in total] if n else old for n, total, old in zip(counts, totals, centroids)]


def usable(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(vec_id, vector) of the vectors of this length without null or non-finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return rows.where(v.isNotNull() & (F.size(v) == dims) & fine).select(F.col(key).alias("vec_id"), v.alias("vector"))


def fitted(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The centroids after the rounds; they start as the vectors whose ids hash least (a null id last, equal ids by vector)."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vector")
    first = hashed.orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    centroids = integers(np.array([r["vector"] for r in first], np.float64), scale).tolist() if first else []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, scale)
    return centroids


def _assigner(centroids: list[list[int]], scale: int):
    def assigned(batches):
        for batch in batches:
            best, least, _ = nearest(_vectors(batch.column(1), scale), centroids)
            distance = [x if x < 1 << 63 else None for x in map(int, least.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return assigned


def clustered(rows: DataFrame, owner: str = "clusters", key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each usable vector.

    Vectors that are null, of another length, or hold null or non-finite components take no part. Fewer than k vectors make
    as many clusters. Repeated rows and equal vectors each count; equal starts leave the higher-numbered ones empty. Sums and distances are exact whatever the
    numbers' size; a distance or an inertia beyond a long is null. An empty table gives an empty result."""
    spark = rows.sparkSession
    prepare(spark)
    vectors = usable(rows, key, vector, dims)
    centroids = fitted(vectors, k, rounds, seed, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = saved(vectors.mapInArrow(_assigner(centroids, scale), f"vec_id {kind}, cluster int, distance long"), owner, "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("known"), F.count("*").alias("n")).collect()

    def long_(total, whole):
        return int(total) if whole and total < 1 << 63 else None

    whole = all(r["known"] == r["n"] for r in sums)
    every = long_(sum(int(r["s"] or 0) for r in sums), whole)
    facts = [(r["cluster"], long_(r["s"] or 0, r["known"] == r["n"]), every, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    return found.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
