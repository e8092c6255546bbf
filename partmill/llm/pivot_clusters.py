"""Centroid clustering with a LAESA pivot table.

Vectors become integers. A few fixed pivots are picked among the first centroids, each as far as can
be from those before it, and every vector's distances to them are stored once. In every round the
centroids' own pivot distances are worked out; the largest difference over the pivots bounds each
vector's distance to each centroid from below. The centroid with the least bound is measured first,
and only centroids whose bound does not exceed that distance get an exact integer distance. Bounds
are compared with a slack far above the rounding of doubles, so results are those of a full search.

Defined cases: a vector is kept when it has exactly `dims` components, none null, non-finite or of
size 2^19 and more (with such, a squared distance may leave 64 bits); other rows are left out. A
null id is hashed as an empty one. Rows that repeat an id each count; as first centroids they are
ordered by their components. With fewer kept vectors than centroids there are as many centroids as
vectors. An empty table gives no rows. An inertia beyond 64 bits is null. Other columns are ignored.

Scale: a round is one pass over the pivot table without a shuffle of vectors; each task passes on the
sums of its clusters (centroids x components numbers), which are added up before the driver reads
them. Only the centroids are sent to tasks. All rounds read written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import materialize

LARGEST = float(1 << 19)
BLOCK = 1024


def kept_vector(vector: Column, dims: int = 64) -> Column:
    return (F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))


def whole(rows: np.ndarray) -> np.ndarray:
    """Components as integers: floor(256 x)."""
    return np.floor(rows * 256.0).astype(np.int64)


def gaps(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of every row to every point."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1).astype(np.float64)) for p in points], axis=1)


def pick_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, each the farthest from those picked before it."""
    picked, least = [0], ((points - points[0]) ** 2).sum(1)
    while len(picked) < min(n, len(points)):
        picked.append(int(least.argmax()))
        least = np.minimum(least, ((points - points[picked[-1]]) ** 2).sum(1))
    return points[picked]


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); ties go to the smaller number."""
    cluster, distance = np.empty(len(rows), np.int32), np.empty(len(rows), np.int64)
    for i in range(0, len(rows), BLOCK):
        v, p = rows[i:i + BLOCK], to_pivots[i:i + BLOCK]
        low = np.zeros((len(v), len(centroids)))
        for j in range(p.shape[1]):
            np.maximum(low, np.abs(p[:, j, None] - centroid_pivots[None, :, j]), out=low)
        bound = np.sqrt(((v - centroids[low.argmin(1)]) ** 2).sum(1).astype(np.float64))
        row, c = np.nonzero(low <= (bound * (1 + 1e-9) + 1e-3)[:, None])
        exact = np.full(low.shape, np.iinfo(np.int64).max)
        exact[row, c] = ((v[row] - centroids[c]) ** 2).sum(1)
        cluster[i:i + BLOCK] = exact.argmin(1)
        distance[i:i + BLOCK] = exact.min(1)
    return cluster, distance


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _to_pivots(pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1]))
            p = gaps(v, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary()), pa.array([x.tobytes() for x in p], pa.binary())], ["id", "v", "p"])
    return run


def _assign(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    """Function from a batch to (rows, cluster, distance)."""
    centroid_pivots = gaps(centroids, pivots)

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = _rows(batch["v"], np.int32, centroids.shape[1]).astype(np.int64)
        return v, *nearest(v, _rows(batch["p"], np.float64, len(pivots)), centroids, centroid_pivots)
    return run


def _sums(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    """(cluster, place, total): what a task's vectors add to their clusters; place -1 holds their number."""
    assign = _assign(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            v, cluster, _ = assign(batch)
            np.add.at(total[:, 1:], cluster, v)
            total[:, 0] += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dims), len(used)), pa.int32()), pa.array(total[used].ravel(), pa.int64())],
            ["cluster", "place", "total"])
    return run


def _final(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    assign = _assign(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = assign(batch)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])
    return run


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, pivots: int = 16, seed: int = 2, dims: int = 64,
             id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components)."""
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), vector.alias("v")).where(kept_vector(F.col("v"), dims))
    id_type = kept.schema["id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select("v", order.alias("order")).orderBy("order", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = whole(np.array([row.v for row in first]))
    fixed = pick_pivots(centroids, pivots)
    table = materialize(kept.mapInArrow(_to_pivots(fixed), f"id {id_type}, v binary, p binary"), "pivot-table")
    for _ in range(rounds):
        sums = table.mapInArrow(_sums(centroids, fixed), "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
        total = np.zeros((len(centroids), dims + 1), np.int64)
        for row in sums.collect():  # a number for each centroid and component
            total[row.cluster, row.place + 1] = row.total
        full = total[:, 0] > 0
        centroids = centroids.copy()
        centroids[full] = np.floor_divide(total[full, 1:], total[full, :1])
    placed = materialize(table.mapInArrow(_final(centroids, fixed), f"id {id_type}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def fits(total) -> int | None:
        return int(total) if total < 1 << 63 else None
    parts = spark.createDataFrame(
        [(c, fits(s), fits(sum(inertia.values())), [int(x) for x in centroids[c]]) for c, s in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = placed.join(F.broadcast(parts), "cluster")  # a row for each centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """Lower-case SHA-256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ",").cast("binary"), 256)
