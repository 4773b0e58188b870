"""Centroid clustering: k-means whose distance bounds follow moved centroids by planar geometry.

Vectors are integers (`floor(scale * x)`), so squared distances and centroids are exact. Each vector carries its
cluster and a lower bound on its distance to every other centroid. When centroids move, the members of a
cluster lie in a sphere around its old centroid; for another centroid that moved from a to b, the
distance of a member shrinks by d(x, a) - d(x, b), and the points where that exceeds v are one branch of a hyperbola
with foci a and b. The branch lies inside the cone of its asymptotes, whose half-angle t has cos t = v / |b - a|.
In the plane through a, b and the sphere's centre, the sphere's least angle to the axis, seen from the midpoint of a and b, is the
centre's angle less asin(radius / distance): the bound is loosened by |b - a| times the cosine of that angle, not by
the whole drift |b - a|. A vector whose exact distance to its own centroid stays below its bound, or below half the distance to
the next centroid, keeps its cluster; all others are ambiguous and compared with every centroid exactly.

A round is one pass over the vectors, which are never shuffled, and one aggregation of k rows per task. The driver
holds centroids, radii and k x k bounds: sizes that do not grow with the input. The state of a round is a table in the
shared folder, so a lost executor costs its tasks only.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; components beyond
+-2^27 after scaling are set to that bound (squared distances then always fit a long); rows that repeat are
clustered each, a null vec_id as well, but starts are drawn from other rows first; equal distances go to the smaller
number; equal starts stay apart by number; fewer vectors than `k` give as many centroids; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LARGEST = 1 << 27
#: Below this, products and their sums are whole numbers that doubles hold.
WHOLE = 1 << 22
#: Share by which bounds are widened against rounding.
SLACK = 1e-9
STATE = "vec_id long, v binary, cluster int, low double"


def whole_vectors(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values  # None for a null list
                if x is None or len(x) != dim or x.null_count:
                    continue
                x = x.to_numpy()
                if np.isfinite(x).all():
                    most = LARGEST / scale
                    ids.append(i)
                    blobs.append(np.floor(np.clip(x, -most, most) * scale).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["vec_id", "v"])

    return run


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= WHOLE:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = (d * d).sum(1)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number on ties; a lower bound of the distance to all others)."""
    far = squared(x, centroids)
    rows, first = np.arange(len(x)), far.argmin(1)
    far[rows, first] = np.iinfo(np.int64).max
    return first.astype(np.int32), np.sqrt(far.min(1).astype(np.float64)) * (1 - SLACK) if far.shape[1] > 1 else np.full(len(x), np.inf)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the distance of a member to any other centroid may have shrunk."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((b - a) ** 2).sum(1))
    moved = drift > 0
    axis = np.zeros_like(a)
    axis[moved] = (b - a)[moved] / drift[moved, None]
    toward = a[:, None, :] - ((a + b) / 2)[None, :, :]  # from the midpoint of j's way to the centre of i's sphere
    far = np.sqrt((toward ** 2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((toward * axis[None, :, :]).sum(2) / far, -1, 1)) - np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    outside = far > radius[:, None] * (1 + SLACK)
    cosine = np.where(outside, np.cos(np.clip(np.nan_to_num(angle), 0, np.pi)), 1.0)
    out = drift[None, :] * np.clip(cosine + SLACK, 0, 1)
    np.fill_diagonal(out, 0)
    return out.max(1, initial=0) * (1 + SLACK)


def _first(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, low = nearest(_matrix(batch.column(1), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(low)], ["vec_id", "v", "cluster", "low"])

    return run


def keeps(x: np.ndarray, cluster: np.ndarray, low: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Vectors that cannot have changed their cluster."""
    d = x - centroids[cluster]
    own = np.sqrt((d * d).sum(1).astype(np.float64)) * (1 + SLACK)
    return own < np.maximum(low, half[cluster]) * (1 - SLACK)


def _again(centroids: np.ndarray, loose: np.ndarray):
    gap = np.sqrt(squared(centroids, centroids).astype(np.float64))
    np.fill_diagonal(gap, np.inf)
    half = gap.min(1, initial=np.inf) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, cluster = _matrix(batch.column(1), centroids.shape[1]), batch.column(2).to_numpy().copy()
                low = batch.column(3).to_numpy() - loose[cluster]
                ask = np.flatnonzero(~keeps(x, cluster, low, centroids, half))
                if len(ask):
                    cluster[ask], low[ask] = nearest(x[ask], centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(low)], ["vec_id", "v", "cluster", "low"])

    return run


def _sums(centroids: np.ndarray):
    """Of each task: for each of its clusters sums of the components, number of members (place -1), largest squared distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        total, count, far = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, cluster = _matrix(batch.column(1), dim), batch.column(2).to_numpy()
                np.add.at(total, cluster, x)
                count += np.bincount(cluster, minlength=k)
                np.maximum.at(far, cluster, ((x - centroids[cluster]) ** 2).sum(1))
        has = np.flatnonzero(count)
        if len(has):
            values = np.concatenate([count[has, None], total[has]], 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(has, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dim, dtype=np.int32), len(has))), pa.array(values), pa.array(np.repeat(far[has], dim + 1))],
                                             ["cluster", "place", "total", "far"])

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids after the round, radius of each cluster around the old one); k x (dim + 1) rows come to the driver."""
    rows = state.mapInArrow(_sums(centroids), "cluster int, place int, total long, far long").groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.max("far").alias("far")).collect()
    count = {r.cluster: r.total for r in rows if r.place < 0}
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in rows:
        if r.place >= 0:
            new[r.cluster, r.place] = r.total // count[r.cluster]
        radius[r.cluster] = np.sqrt(float(r.far)) * (1 + SLACK)
    return new, radius


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column(2)
                d = _matrix(batch.column(1), centroids.shape[1]) - centroids[cluster.to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), cluster, pa.array((d * d).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(table: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    shape = "vec_id long, cluster int, distance long"
    held = Scratch(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = held.keep(rows.mapInArrow(whole_vectors(dim, scale), "vec_id long, v binary"))
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.withColumn("turn", turn).orderBy(F.col("turn").asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        empty = spark.createDataFrame([], shape)
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids = np.stack([np.frombuffer(r.v, "<i4").astype(np.int64) for r in starts])
    now = Scratch(spark)
    state = now.keep(vectors.mapInArrow(_first(centroids), STATE))
    held.drop()
    for _ in range(rounds):
        new, radius = moved_centroids(state, centroids)
        loose = loosening(centroids, new, radius)
        held, now = now, Scratch(spark)
        state = now.keep(state.mapInArrow(_again(new, loose), STATE))
        held.drop()
        centroids = new
    done = Scratch(spark).keep(state.mapInArrow(_distances(centroids), shape))
    now.drop()
    sums = {r.cluster: r.total for r in done.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows at most
    ends = spark.createDataFrame([(c, sums[c], sum(sums.values()), digest_of(centroids[c])) for c in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
