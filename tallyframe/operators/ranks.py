"""Ranks with ties averaged, and blends of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import forget, written


#: Rows that one task may sum, rows that may be broadcast, and from which share and number of rows on a key is hot.
ONE_TASK, MOST_BROADCAST = 1_000_000, 500_000
HOT_SHARE, HOT_ROWS = 1e-4, 1000


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """rows with the sum of `value` over the rows of their keys before each in an order, and over all of them ({out}_all).

    Rows are written first, so that what makes them runs once. Up to ONE_TASK of them are summed in a window for each key.
    More are dealt out by ranges of (keys, order) and summed in each; a row for each range holds the sum of those before
    it. So no task sees more rows than that.
    """
    rows = written(rows, "counts")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    if rows.count() <= ONE_TASK:
        own = Window.partitionBy(*keys)
        return rows.withColumns({out: F.coalesce(F.sum(value).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), f"{out}_all": F.sum(value).over(own)})
    dealt = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    forget(rows)
    parts = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before.orderBy("_part")), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(before.partitionBy("_part").orderBy(*keys, *order)), F.lit(0))
    told = dealt.join(F.broadcast(parts), "_part").withColumn(out, F.col("_before") + own).drop("_part", "_before")
    whole = told.groupBy(*keys).agg(F.min(out).alias("_first"), F.sum(value).alias(f"{out}_all"), F.count(F.lit(1)).alias("_rows"))
    return looked_up(told, whole, keys, "_rows").withColumn(out, F.col(out) - F.col("_first")).drop("_first", "_rows")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, a row for each key; a null key equals a null key."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys], F.lit(True))
    return left.join(right, same, how).drop(*[f"_{k}" for k in keys])


def looked_up(rows: DataFrame, told: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with the other columns of `told`, which has a row for each of their keys and its number of rows in `count`.

    A small `told` is broadcast. Of a larger one only the keys with very many rows are, 10,000 at most, so that the rows
    of none of them meet in one task; the others are joined by a shuffle. A null key equals a null key.
    """
    n, n_rows = told.agg(F.count(F.lit(1)), F.sum(count)).first()
    if n <= MOST_BROADCAST:
        return joined(rows, F.broadcast(told), keys)
    others = [c for c in told.columns if c not in keys]
    hot = F.col(count) > max(HOT_ROWS, HOT_SHARE * n_rows)
    marked = joined(rows, F.broadcast(told.where(hot)), keys, "left")
    cold = joined(marked.where(F.col(count).isNull()).drop(*others), told.where(~hot), keys)
    return cold.unionByName(marked.where(F.col(count).isNotNull()))


def with_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `avg_rank`, the 1-based rank of value within keys, ties averaged, and `n`, the rows of its keys.

    Rows are counted by value first and the counts summed along the order (running_total). Ranks come back to the rows by
    looked_up, so neither a key nor a value with most of the rows makes one task. Nulls rank first and tie with each other.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    told = running_total(counts, keys, [value], "_n", "_below")
    told = told.select(*keys, value, F.col("_below_all").alias("n"), (F.col("_below") + (F.col("_n") + 1) / 2).alias("avg_rank"), "_n")
    return looked_up(rows, told, [*keys, value], "_n").drop("_n")


def percentile() -> Column:
    """A row's share of its group, in (0, 1], from the columns of with_ranks."""
    return F.col("avg_rank") / F.col("n")


def fold_rank(value: str) -> Column:
    """avg_rank scaled to 0..1, from the columns of with_ranks; the value itself where a group has one row."""
    return F.when(F.col("n") > 1, F.try_divide(F.col("avg_rank") - 1, F.col("n") - 1)).otherwise(F.col(value))


def rank_average(scores: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(id, label, score): weighted mean over members of percentile ranks, from (member, id, label, p).

    weights: (member, w), few rows; members without one weigh 1. Equal scores of a member share a rank.
    """
    ranked = with_ranks(scores.select("member", "id", "label", "p"), ["member", "label"], "p").select("member", "id", "label", percentile().alias("r"))
    if weights is not None:
        ranked = ranked.join(weights, "member", "left")
    w = F.coalesce(F.col("w"), F.lit(1.0)) if weights is not None else F.lit(1.0)
    return ranked.groupBy("id", "label").agg((F.sum(F.col("r") * w) / F.sum(w)).alias("score"))


def members_agree(scores: DataFrame) -> DataFrame:
    """(id, members): ids that not all members have; empty when the members' ids are the same sets."""
    n = scores.agg(F.count_distinct("member").alias("n"))
    each = scores.groupBy("id").agg(F.count_distinct("member").alias("members"))
    return each.join(F.broadcast(n), F.col("members") < F.col("n")).select("id", "members")
