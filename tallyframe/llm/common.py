"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import forget, shared_dir, shared_path, written

__all__ = ["HOT_ROWS", "HOT_SHARE", "components", "forget", "join_groups", "shared_dir", "shared_path", "small", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else df: Spark then joins by a shuffle."""
    return F.broadcast(df) if rows <= most else df


#: Groups of more than this share of all rows, and of HOT_ROWS rows, are joined by a broadcast: 10,000 of them at most.
HOT_SHARE, HOT_ROWS = 1e-4, 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """rows with the columns of the groups they are in (groups: a row for each key, with its number of rows in `count`).

    The rows of a large group don't meet in one task: large groups are few, so they are broadcast. Rows without a group
    are left out. `rows` is read twice.
    """
    hot = F.col(count) > max(HOT_ROWS, HOT_SHARE * n_rows)
    marked = rows.join(F.broadcast(groups.where(hot)), keys, "left")
    others = [c for c in groups.columns if c not in keys]
    rest = marked.where(F.col(count).isNull()).drop(*others).join(groups.where(~hot), keys)
    return rest.unionByName(marked.where(F.col(count).isNotNull()))


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components: (node, component) for each node of edges (a, b); component is the smallest node reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each two shuffles of the edges, until no edge
    changes; each step's edges are written in the shared folder, and those of the step before deleted. Edges of a node with itself and nulls are dropped.
    """
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    now = edges.where("a <> b").select(pair(F.col("a"), F.col("b")).alias("e")).select("e.*").distinct()
    now = written(now, what)
    before = None
    while True:
        # large star: a node's larger neighbours are tied to the smallest node around it
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        # small star: a node's smaller neighbours and the node itself are tied to the smallest of them
        large = large.distinct()
        tops = large.groupBy("b").agg(F.min("a").alias("m"))
        small_star = large.join(tops, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        before_step, now = now, written(small_star, what)
        forget(before_step)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    ties = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    found = written(ties.union(ties.select(F.col("component").alias("node"), "component").distinct()), what)
    forget(now)
    return found
