"""Operator 1: near-duplicate vectors by a subspace pigeonhole join.

Vectors of length 1 whose cosine is at least t are at most sqrt(2 - 2t) apart. They are rotated and split into blocks;
each block gets the share of the squared distance that it has of the dimensions, so a pair within the bound is within
its share in some block. Each block is range-joined: a vector lives in one cell of a grid over the block's first
dimensions and visits every cell that its share of the distance reaches. Candidates of any block are checked in full.
Cells of few vectors are gathered by a shuffle; the members of larger ones meet chunk by chunk, each vector stored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Added to squared distances, over what rounding can take from them.
SLACK = 1e-9
#: Chunks of a partition that meet those of another in one task.
MOST_CHUNKS = 32
#: Spark's setting of the rows that a task of Python gets at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x by powers of two, so that their largest component is 0.5 to 1: squares stay within range, and cosines are
    the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows of x at length 1, rotated. Sums run in a fixed order, so a row's result doesn't depend on other rows."""
    x = scaled(x)
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    q, out = rotation(x.shape[1]), np.zeros_like(unit)
    for k in range(x.shape[1]):
        out += unit[:, k : k + 1] * q[k]
    return out


class Blocks:
    """Blocks of a dimension, their shares of the squared distance and their grids."""

    def __init__(self, dim: int, threshold: float, blocks: int, grid: int, width: float):
        self.cols = [c for c in np.array_split(np.arange(dim), min(blocks, dim)) if len(c)]
        whole = 2 * (1 - threshold) + SLACK
        self.share = [whole * len(c) / dim for c in self.cols]
        self.grid, self.width = grid, width

    def visits(self, u: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it lives there) for each cell that a rotated vector lives in or visits in block b."""
        g = min(self.grid, len(self.cols[b]))
        at = u[:, self.cols[b][:g]]
        at = at + self.width / 2  # most vectors are near 0: the middle of a cell, not its edge
        home = np.floor(at / self.width).astype(np.int64)
        reach = int(np.ceil(np.sqrt(self.share[b]) / self.width))
        rows, cells, lives = [], [], []
        for step in product(range(-reach, reach + 1), repeat=g):
            low = (home + np.array(step)) * self.width
            gap = np.maximum(0, np.maximum(low - at, at - (low + self.width)))
            hit = np.flatnonzero((gap * gap).sum(1) <= self.share[b] + SLACK)
            rows.append(hit)
            cells.append(((home[hit] + np.array(step) + (1 << 15)) << (16 * np.arange(g) % 64)).sum(1))
            lives.append(np.full(len(hit), not any(step)))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(lives)

    def apart(self, u: np.ndarray, v: np.ndarray, b: int) -> np.ndarray:
        """Squared distances of rows in block b."""
        d = np.ascontiguousarray(u[:, self.cols[b]] - v[:, self.cols[b]])
        return np.einsum("ij,ij->i", d, d)

    def linked(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, b: int, threshold: float, rows: int = 1024, u: np.ndarray | None = None, v: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (i, j), ids[i] < others[j], whose cosine is at least threshold and whose first block within its
        share is b: every linked pair comes up in one block, where the smaller id lives. u and v: x and y rotated, if known."""
        first, last = np.argsort(ids, kind="stable"), np.argsort(others, kind="stable")
        x, ids, y, others = x[first], ids[first], y[last], others[last]
        x, y = scaled(x), scaled(y)
        u, v = rotated(x) if u is None else u[first], rotated(y) if v is None else v[last]
        # one product gives the squared distances: (p, |p|^2, 1) . (-2 q, 1, |q|^2)
        p, q = u[:, self.cols[b]], v[:, self.cols[b]]
        one = lambda m: np.ones((len(m), 1))
        small = np.hstack([p, (p * p).sum(1)[:, None], one(p)]).astype(np.float32)
        large = np.ascontiguousarray(np.hstack([-2 * q, one(q), (q * q).sum(1)[:, None]]).astype(np.float32).T)
        found = []
        for a in range(0, len(x), rows):
            start = int(np.searchsorted(others, ids[a], "right"))
            if start == len(y):
                continue
            near = np.flatnonzero((small[a : a + rows] @ large[:, start:]).ravel() <= np.float32(self.share[b] + 1e-4))
            i, j = np.divmod(near, len(y) - start)
            j += start
            i += a
            keep = ids[i] < others[j]
            i, j = i[keep], j[keep]
            ok = self.apart(u[i], v[j], b) <= self.share[b]
            for before in range(b):
                ok &= self.apart(u[i], v[j], before) > self.share[before]
            i, j = i[ok], j[ok]
            dot = np.einsum("ij,ij->i", x[i], y[j])
            norm = np.sqrt(np.einsum("ij,ij->i", x[i], x[i]) * np.einsum("ij,ij->i", y[j], y[j]))
            ok = dot / norm >= threshold
            found.append((first[i[ok]], last[j[ok]]))
        return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that edges (i, j) reach."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int = 4, grid: int = 2, width: float = 0.5, tile: int = 8192) -> DataFrame:
    """(id, n_links, component, kept): how many other vectors have a cosine of at least threshold with each, and the
    smallest id that links reach; kept where that is the vector's own.

    Null, empty and zero vectors, and those with a null or a number that isn't finite, link with nothing, and so do
    vectors of different lengths. A cosine of exactly threshold (a tie) links. Finite vectors of any size count. Extra
    columns, whatever their names, are not carried; an empty table gives an empty table. Equal vectors are joined as one and counted as many. Each id is taken to name one
    vector: rows that repeat an id count as vectors of their own in n_links and are tied in one component. Null ids link
    with nothing. Vectors of cells with more than `tile` are stored once, in chunks of that many, and each two chunks meet
    without a shuffle: neither a group nor, by more than the input, the disk grows with the pairs. What links have is summed
    for each two chunks and never listed pair by pair.
    """
    vec, vec_id = F.col(vec_col).cast("array<double>"), F.col(id_col).cast("long")
    base = vectors.select(vec_id.alias("id"), vec.alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    valid = base.where("id is not null and size(v) > 0").where(finite).where(F.exists("v", lambda e: e != 0.0))
    classes = common.written(valid.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind = np.float32 if single else np.float64
    shape = (threshold, blocks, grid, width)

    def stacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(dimension, row numbers, matrix) for each length of vectors."""
        values = batch.column("v")
        sizes = np.diff(values.offsets.to_numpy())
        flat, starts = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()[:-1]
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            yield int(dim), rows, flat[starts[rows][:, None] + np.arange(dim)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in stacked(batch):
                own, u = Blocks(dim, *shape), rotated(x)
                for b in range(len(own.cols)):
                    _, cell, lives = own.visits(u, b)
                    places, which = np.unique(cell, return_inverse=True)
                    n = len(places)
                    yield pa.record_batch([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(places), pa.array(np.bincount(which, lives, n).astype(np.int64)), pa.array(np.bincount(which, minlength=n).astype(np.int64))], names=["dim", "block", "cell", "living", "there"])

    counted = classes.mapInArrow(cells, "dim int, block int, cell long, living long, there long").groupBy("dim", "block", "cell").agg(F.sum("living").alias("living"), F.sum("there").alias("there"))
    # a row for each cell of the grid over the unit ball, however many vectors there are; only large cells matter
    large = {(r.dim, r.block, r.cell) for r in counted.where(F.col("there") > tile).collect()}
    large_dims = {dim for dim, _, _ in large}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors by the cells that aren't large."""
        for batch in batches:
            reps, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            for dim, rows, x in stacked(batch):
                own, u = Blocks(dim, *shape), rotated(x)
                data = [r.tobytes() for r in np.ascontiguousarray(x.astype(kind))]
                for b in range(len(own.cols)):
                    w, c, home = own.visits(u, b)
                    few = ~np.isin(c, [cell for d, block, cell in large if (d, block) == (dim, b)])
                    w, c, home = w[few], c[few], home[few]
                    yield pa.record_batch([pa.array(np.full(len(w), dim, np.int32)), pa.array(np.full(len(w), b, np.int32)), pa.array(c, pa.int64()), pa.array(reps[rows][w]), pa.array(copies[rows][w]), pa.array(home), pa.array([data[k] for k in w.tolist()], pa.binary())], names=["dim", "block", "cell", "id", "copies", "lives", "raw"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of lengths that have large cells, in rows of up to `tile` of one length."""
        number, held = TaskContext.get().partitionId() << 32, {}

        def row(dim: int, part: list[np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in part)], names=["chunk", "dim", "ids", "copies", "raw"])

        for batch in batches:
            reps, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            for dim, rows, x in stacked(batch):
                if dim in large_dims:
                    part = [reps[rows], copies[rows], x.astype(kind)]
                    held[dim] = [np.concatenate(p) for p in zip(held[dim], part, strict=True)] if dim in held else part
                    while len(held[dim][0]) >= tile:
                        yield row(dim, [p[:tile] for p in held[dim]])
                        number, held[dim] = number + 1, [p[tile:] for p in held[dim]]
        for dim, part in held.items():
            if len(part[0]):
                yield row(dim, part)
                number += 1

    def summed(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
        """(id, n, root) of the links between the rows i and j."""
        names, where = np.unique(ids, return_inverse=True)
        i, j = where[i], where[j]
        have = np.zeros(len(names), np.int64)
        have[where] = copies
        n = np.zeros(len(names), np.int64)
        np.add.at(n, i, have[j])
        np.add.at(n, j, have[i])
        root, some = _roots(len(names), i, j), np.flatnonzero(n)
        return pa.table({"id": names[some], "n": n[some], "root": names[root[some]]})

    def join_cell(key: tuple, group: pa.Table) -> pa.Table:
        dim, b = key[0].as_py(), key[1].as_py()
        x = np.frombuffer(b"".join(r.as_py() for c in group.column("raw").chunks for r in c), kind).reshape(-1, dim).astype(np.float64)
        ids, left = group.column("id").to_numpy(), np.flatnonzero(group.column("lives").to_numpy())
        i, j = Blocks(dim, *shape).linked(x[left], x, ids[left], ids, b, threshold)
        return summed(ids, group.column("copies").to_numpy(), left[i], j)

    def join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}

        def opened(row: dict, side: str) -> tuple:
            """(ids, copies, vectors, rotated ones, {(block, cell): (those that live there, those there)}) of a chunk."""
            if (number := row[f"chunk_{side}"]) not in seen:
                dim = row["dim_a"]
                ids, copies = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("ids", "copies"))
                x = np.frombuffer(row[f"raw_{side}"], kind).reshape(-1, dim).astype(np.float64)
                own, u, there = Blocks(dim, *shape), rotated(x), {}
                for b in range(len(own.cols)):
                    who, cell, lives = own.visits(u, b)
                    for c in np.unique(cell).tolist():
                        if (dim, b, c) in large:
                            there[b, c] = who[(cell == c) & lives], who[cell == c]
                if len(seen) > 1:  # the left chunk of a task stays for many right ones
                    seen.pop(next(k for k in seen if k != row["chunk_a"]))
                seen[number] = ids, copies, x, u, there
            return seen[number]

        for batch in batches:
            for row in batch.to_pylist():
                if row["dim_a"] != row["dim_b"]:
                    continue
                left, right = opened(row, "a"), opened(row, "b")
                own, found = Blocks(row["dim_a"], *shape), []
                # the smaller id of a link is in either chunk
                for (p, at_p), (q, at_q) in (((left, 0), (right, len(left[0]))), ((right, len(left[0])), (left, 0)))[: 1 + (left is not right)]:
                    for key in p[4].keys() & q[4].keys():
                        w, z = p[4][key][0], q[4][key][1]
                        i, j = own.linked(p[2][w], q[2][z], p[0][w], q[0][z], key[0], threshold, u=p[3][w], v=q[3][z])
                        found.append((w[i] + at_p, z[j] + at_q))
                if found:
                    i, j = (np.concatenate(f) for f in zip(*found, strict=True))
                    yield from summed(*(np.concatenate([left[k], right[k]]) for k in (0, 1)), i, j).to_batches()

    n_rows = classes.agg(F.sum("copies")).first()[0] or 0
    few = classes.mapInArrow(dealt, "dim int, block int, cell long, id long, copies long, lives boolean, raw binary")
    part = common.written(few.groupBy("dim", "block", "cell").applyInArrow(join_cell, "id long, n long, root long"), "near")
    if large:
        spark = vectors.sparkSession
        chunks = common.written(classes.mapInArrow(chunked, "chunk long, dim int, ids binary, copies binary, raw binary"), "chunks")
        n = chunks.count()
        # partitions meet each other one by one: some tasks for each core, and few chunks in each
        chunks_out = chunks.repartition(min(n, max(ceil(sqrt(16 * spark.sparkContext.defaultParallelism)), ceil(n / MOST_CHUNKS))))
        a, b = (chunks_out.select(*(F.col(c).alias(f"{c}_{side}") for c in chunks.columns)) for side in "ab")
        met = a.crossJoin(b).where("chunk_a <= chunk_b").mapInArrow(join_chunks, "id long, n long, root long")
        before = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, "1")  # two chunks are some MB
        try:
            part = part.unionByName(common.written(met, "near"))
        finally:
            spark.conf.set(_BATCH, before)
        common.forget(chunks)
    members = common.written(common.join_groups(valid, classes, ["v"], "copies", n_rows).select("id", "rep", "copies"), "members")
    links = part.groupBy("id").agg(F.sum("n").alias("n"))
    # rows that repeat an id tie the classes they are in
    ties = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    several = members.join(ties.select(F.col("a").alias("rep")).union(ties.select(F.col("b").alias("rep"))).distinct(), "rep", "left_semi")
    edges = part.select(F.col("id").alias("a"), F.col("root").alias("b")).union(several.select(F.col("id").alias("a"), F.col("rep").alias("b"))).where("a <> b").distinct()
    found = common.components(edges, "near")
    each = members.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    each = each.groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = base.select("id").join(each, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"), (F.col("id") == F.coalesce("component", "id")).alias("kept"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(common.table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


QUERIES = {"op1_near_vectors": op1_near_vectors}
ORACLES: dict[str, str] = {
    "op1_near_vectors": r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = r),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN n ON a = vec_id GROUP BY vec_id
"""
}
