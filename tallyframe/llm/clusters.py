"""Operator 13: k-means by Elkan's bounds (2003), in whole numbers.

Each vector carries an upper bound of the distance to its centroid and a lower bound to each centroid. When centroids
move, bounds move by as much; distances between centroids show which can't be nearer. Bounds are rounded away from the
distances they bound and prune only what is strictly farther, so ties are decided by exact whole distances alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Whole components of this size and more could overflow whole distances.
LIMIT = float(1 << 27)
#: More than what rounding takes from a square root or adds to it, as a share.
_SLACK = 2.0**-50


def below(x: np.ndarray) -> np.ndarray:
    """float32 numbers at most x, and at least 0."""
    near = np.maximum(x, 0).astype(np.float32)
    return np.where(near > x, np.maximum(np.nextafter(near, np.float32(-np.inf)), np.float32(0)), near)


def above(x: np.ndarray) -> np.ndarray:
    """float32 numbers at least x."""
    near = x.astype(np.float32)
    return np.where(near < x, np.nextafter(near, np.float32(np.inf)), near)


def root_below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - _SLACK)


def root_above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + _SLACK)


class Bounds:
    """What one assignment needs of the centroids: half of the least distances between them, and how far they moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        self.moved = None if before is None else root_above(((centroids - before) ** 2).sum(1))
        k = len(centroids)
        self.half = np.stack([root_below(((centroids - c) ** 2).sum(1)) / 2 for c in centroids]) if k else np.zeros((0, 0))
        other = self.half + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.nearest = other.min(1) if k else np.zeros(0)

    def assign(self, x: np.ndarray, a: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(centroid, upper bound, lower bounds, exact squared distance, distances calculated) of rows of x, from their
        centroids and bounds before the move, if any."""
        n, k = len(x), len(self.centroids)
        if a is None:
            d = np.stack([((x - c) ** 2).sum(1) for c in self.centroids], 1)
            a = d.argmin(1)  # of equal distances the first
            least = d[np.arange(n), a]
            return a, above(root_above(least)), below(root_below(d)), least, n * k
        a = a.astype(np.int64)
        upper = above(upper.astype(np.float64) + self.moved[a])
        lower = below(lower.astype(np.float64) - self.moved)
        # an own distance is a result in any case; it also makes the upper bound tight
        least = ((x - self.centroids[a]) ** 2).sum(1)
        calculated = n
        open_rows = np.flatnonzero(upper >= self.nearest[a])
        upper[open_rows] = above(root_above(least[open_rows]))
        open_rows = open_rows[upper[open_rows] >= self.nearest[a[open_rows]]]
        lower[np.arange(n), a] = below(root_below(least))
        for c in range(k):
            of = a[open_rows]
            rows = open_rows[(of != c) & (lower[open_rows, c] <= upper[open_rows]) & (self.half[of, c] <= upper[open_rows])]
            if not len(rows):
                continue
            d = ((x[rows] - self.centroids[c]) ** 2).sum(1)
            calculated += len(rows)
            lower[rows, c] = below(root_below(d))
            nearer = (d < least[rows]) | ((d == least[rows]) & (c < a[rows]))
            rows, d = rows[nearer], d[nearer]
            a[rows], least[rows] = c, d
            upper[rows] = above(root_above(d))
        return a, upper, lower, least, calculated


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """(id, v, cluster, upper, lower, distance, calculated) of vectors (id, v, and the columns of the assignment before)."""
    bounds = Bounds(centroids, before)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x = _matrix(b.column("v"), np.int64)
                cached = (b.column("cluster").to_numpy(), b.column("upper").to_numpy(), _matrix(b.column("lower"), np.float32)) if before is not None else (None, None, None)
                a, upper, lower, least, calculated = bounds.assign(x, *cached)
                told = np.zeros(len(x), np.int64)
                told[:1] = calculated
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(centroids), pa.int32()), pa.array(lower.ravel(), pa.float32()))
                yield pa.record_batch([b.column("id"), b.column("v"), pa.array(a.astype(np.int32)), pa.array(upper, pa.float32()), lists, pa.array(least), pa.array(told)], names=["id", "v", "cluster", "upper", "lower", "distance", "calculated"])

    columns = ["id", "v"] + (["cluster", "upper", "lower"] if before is not None else [])
    return state.select(*columns).mapInArrow(nearest, "id long, v array<int>, cluster int, upper float, lower array<float>, distance long, calculated long")


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors; a centroid without any stays. Tasks add up their own first; the
    driver gets a number for each centroid and component."""
    k, dim = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                a = batch.column("cluster").to_numpy()
                np.add.at(sums, a, _matrix(batch.column("v"), np.int64))
                counts += np.bincount(a, minlength=k)
        c, place = np.nonzero(np.ones((k, dim + 1), bool) & (counts > 0)[:, None])
        each = np.hstack([sums, counts[:, None]])[c, place]
        yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(each)], names=["cluster", "place", "total"])

    totals = state.select("cluster", "v").mapInArrow(summed, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    told = {(r.cluster, r.place): int(r.total) for r in totals.collect()}
    out = centroids.copy()
    for c in range(k):
        if n := told.get((c, dim)):
            out[c] = [told[c, i] // n for i in range(dim)]
    return out


def quantised(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors of `dim` components, none null or not finite, each as floor(scale * component)."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform("v", lambda e: F.when(F.abs(e) * scale < F.lit(LIMIT), F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for whole distances")).cast("int")))
    return base.where(F.size("v") == dim).where(finite).select("id", whole.alias("v"))


def elkan(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, upper, lower, calculated) of each vector, and the final centroids, k x dim at most.

    Vectors are made whole as in `quantised`; those of another length, null, or with a null or infinite component are left
    out. The k vectors whose id has the smallest sha256 of `seed:id` are the first centroids (equal ids: the smaller
    vector); with fewer vectors there are fewer. Rounds assign each vector to the nearest centroid (ties: the smaller number) and
    move centroids to the floor of their vectors' mean; then vectors are assigned once more. A centroid without vectors stays.

    Repeated rows and ids are vectors of their own; a null id is assigned too but starts no centroid. Without any centroid,
    or vectors, the result is empty. Extra columns, whatever their names, are not carried. A component of 2^27 / scale and
    more, of which whole distances could overflow, is an error, never a wrong result. Centroids, k x dim numbers and k x k distances,
    are the only thing that the driver holds; each round's bounds are written in the shared folder, the round's before deleted.
    """
    state = common.written(quantised(vectors, dim, scale, id_col, vec_col), "whole-vectors")
    first = state.where("id is not null").select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h")).orderBy("h", "v").limit(k)
    centroids, before = np.array([r.v for r in first.collect()], np.int64).reshape(-1, dim), None
    if not len(centroids):
        return assigned(state.where("1 = 0"), np.zeros((1, dim), np.int64), None), centroids
    for _ in range(rounds):
        after = common.written(assigned(state, centroids, before), "bounds")
        common.forget(state)
        state, before = after, centroids
        centroids = moved(state, centroids)
    last = common.written(assigned(state, centroids, before).drop("v"), "clusters")
    common.forget(state)
    return last, centroids


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = elkan(common.table(spark, sf_dir, "embeddings"))
    shas = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    told = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # a row for each centroid: k of them
    told = F.broadcast(told.join(F.broadcast(sums), "cluster"))
    whole = F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))
    each = found.select(F.col("id").alias("vec_id"), "cluster", "distance").join(told, "cluster").crossJoin(whole)
    return each.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds, one after another, each comparing all vectors with all centroids."""
    out = [
        "WITH vec AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM vec WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        out += [
            f"d{i} AS (SELECT r, vec_id, vec.v AS v, c, list_sum(list_transform(list_zip(vec.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vec, c{i})",
            f"a{i} AS (SELECT r, vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM d{i}) WHERE place = 1)",
        ]
        if i < rounds:
            out += [
                f"s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i}) GROUP BY c, i)",
                f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c)",
                f"c{i + 1} AS (SELECT c{i}.c AS c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)",
            ]
    last = rounds
    return ",\n".join(out) + f"""
SELECT vec_id, CAST(a{last}.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.c = a{last}.c
"""


QUERIES = {"op13_clusters": op13_clusters}
ORACLES: dict[str, str] = {"op13_clusters": _sql()}
