"""Exact quantiles by selection: histograms narrow down where each rank is, and no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import forget, written

#: Bins of a histogram, and values that are sorted at last.
BINS, FEW = 4096, 4096
#: Rows that a broadcast of groups may have.
MOST_BROADCAST = 2_000_000


def _magnitude(v: Column) -> Column:
    """A number that never falls as v grows: sign and exponent, so that the first bins part values of any size."""
    size = F.log2(F.abs(v)) + 1100
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * size)


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, n, qs): for each key the quantiles of `value` at probs, interpolated between neighbours.

    Values are finite and not null; other rows are left out. A first histogram has a bin for each sign and exponent;
    then the bin that holds a rank is cut into BINS equal ones, over and over, until it has one value or FEW rows, which
    are sorted. Bins have their counts added up on the map side. Each histogram reads the rows once and shuffles a row for
    each bin; a double has 52 bits behind its exponent, so there are five at most. Null keys are a group of their own.
    """
    v = F.col(value).cast("double")
    own = rows.select(*keys, v.alias("v")).where("v is not null and not isnan(v)").where(F.abs("v") < F.lit(float("inf")))
    by_key = [F.col(f"_{k}") for k in keys]
    bins = own.groupBy(*keys, F.floor(_magnitude(F.col("v"))).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    # a key has some 4400 bins at most
    below = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumns({"before": F.coalesce(below, F.lit(0)), "n": F.sum("c").over(Window.partitionBy(*keys))})
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(a).cast("long"), F.ceil(a).cast("long")) for a in at]))
    held = F.filter(wanted, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))
    state = bins.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", F.explode(held).alias("rank"), "low", "high", "before", F.col("c").alias("inside"))
    state = written(state, "ranks")
    while True:
        open_ranks = state.where((F.col("low") < F.col("high")) & (F.col("inside") > FEW))
        count = open_ranks.count()
        if not count:
            break
        within = own.join(_few(open_ranks, count), _same(own, open_ranks, keys) & F.col("v").between(F.col("low"), F.col("high")))
        # halves first: the difference of two large numbers of other signs would overflow
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        cut = within.groupBy(*by_key, "n", "rank", "before", F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        over = Window.partitionBy(*by_key, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(over), F.lit(0))).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        cut = cut.select(*by_key, "n", "rank", "low", "high", "before", F.col("c").alias("inside"))
        done = state.where((F.col("low") >= F.col("high")) | (F.col("inside") <= FEW))
        before, state = state, written(done.unionByName(cut), "ranks")
        forget(before)
    few = state.where("low < high")
    within = own.join(_few(few, few.count()), _same(own, few, keys) & F.col("v").between(F.col("low"), F.col("high")))
    sorted_few = within.groupBy(*by_key, "n", "rank", "before").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    told = sorted_few.select(*by_key, "n", "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("v"))
    told = told.unionByName(state.where("low >= high").select(*by_key, "n", "rank", F.col("low").alias("v")))
    each = told.groupBy(*by_key, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))

    def quantile(a: Column) -> Column:
        low, high = (F.element_at("m", f(a).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (a - F.floor(a))

    return each.select(*[F.col(f"_{k}").alias(k) for k in keys], "n", F.array(*[quantile(a) for a in at]).alias("qs"))
