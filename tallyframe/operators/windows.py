"""Windows over ordered stacks, and pooling of their predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import looked_up
from .splits import placed

#: How each label's windows are pooled, and the softmax temperature beside it.
POOLING = {
    "Fracture": ("max", 10.0),
    "Contusion": ("max", 8.0),
    "Medial Meniscus": ("max", 8.0),
    "Lateral Meniscus": ("max", 8.0),
    "Baker's": ("max", 8.0),
    "ACL": ("top2", 6.0),
    "MCL": ("top2", 6.0),
    "Medial OA": ("mean", None),
    "Lateral OA": ("mean", None),
    "PF OA": ("mean", None),
    "Effusion": ("mean", None),
    "Synovitis": ("mean", None),
}
SOFT_MIX = 0.2
GROUP, BAND, MAX_WINDOWS = 3, (0.2, 0.8), 8


def window_starts(n: Column, group: int = GROUP, band: tuple[float, float] = BAND) -> Column:
    """Starts of all windows of `group` slices inside the central band of n slices; a short stack has one, at 0."""
    low = F.greatest(F.lit(0), F.least(F.floor(n * band[0]).cast("int"), n - group))
    high = F.least(F.ceil(n * band[1]).cast("int"), n)
    last = F.greatest(low, F.least(high - group, n - group))
    return F.when(n < group, F.array(F.lit(0))).otherwise(F.sequence(low, last))


def window_indices(n: Column, start: Column, group: int = GROUP) -> Column:
    """Slices of a window; those of a short stack end at its last."""
    return F.when(n < group, F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda i: F.least(i, n - 1))).otherwise(F.sequence(start, start + group - 1))


def spread(starts: Column, windows: Column) -> Column:
    """`windows` of the starts, evenly spaced, first and last included; halves round to even."""
    n = F.size(starts)
    pick = lambda w: F.get(starts, F.bround(w * (n - 1) / F.greatest(windows - 1, F.lit(1))).cast("int"))
    return F.transform(F.sequence(F.lit(0), windows - 1), pick)


def window_count(most_starts: Column, cap: int = MAX_WINDOWS) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(cap), most_starts))


def central_band(items: Column, low: float = 0.15, high: float = 0.85) -> Column:
    """The middle of an array of 3 items or more; a shorter one whole."""
    n = F.size(items)
    a, b = F.floor(n * low).cast("int"), F.ceil(n * high).cast("int")
    return F.when(n >= 3, F.slice(items, a + 1, F.greatest(b - a, F.lit(1)))).otherwise(items)


def central_rows(rows: DataFrame, key: str, order: list[str], low: float = 0.15, high: float = 0.85) -> DataFrame:
    """rows in the middle of their key's order, with their place there, from 0, as `at`; all of a key of less than 3.

    Rows are numbered by ranges of (key, order), and the ends of keys with very many rows are broadcast (looked_up), so a
    key with most of the rows isn't one task.
    """
    told = placed(rows, [key, *order], "at")
    ends = told.groupBy(key).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own, n = F.col("at") - F.col("_first"), F.col("_n")
    a, b = F.floor(n * low), F.ceil(n * high)
    middle = (n < 3) | ((own >= a) & (own < F.greatest(b, a + 1)))
    return looked_up(told, ends, [key], "_n").where(middle).withColumn("at", F.when(n < 3, own).otherwise(own - a)).select(*rows.columns, "at")


def seeded_start(starts: Column, seed: Column) -> Column:
    """One of the starts, by a hash of the seed."""
    return F.get(starts, F.pmod(F.xxhash64(seed), F.size(starts)).cast("int"))


def pooling_table(spark: SparkSession, pooling=POOLING) -> DataFrame:
    return spark.createDataFrame([(k, m, b) for k, (m, b) in pooling.items()], "label string, mode string, beta double")


def pool(windows: DataFrame, modes: DataFrame, mix: float = SOFT_MIX) -> DataFrame:
    """(id, label, p): predictions of windows (id, label, p) pooled as each label asks, blended with their softmax mean.

    p is a probability: the softmax is taken relative to 1. All but the two best are sums, combined before the exchange;
    of the two best each task hands on its own two, so an id with most of the windows isn't gathered anywhere.
    """
    rows = windows.select("id", "label", "p").join(modes, "label")
    e = F.exp(F.col("beta") * (F.col("p") - 1))
    keys = ["id", "label", "mode"]
    told = rows.groupBy(*keys).agg(F.max("p").alias("top"), F.avg("p").alias("mean"), F.try_divide(F.sum(e * F.col("p")), F.sum(e)).alias("soft"))
    place = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.desc("p")))
    best = rows.where("mode = 'top2'").withColumn("_r", place).where("_r <= 2").groupBy("id", "label").agg(F.avg("p").alias("two"))
    best = best.select(F.col("id").alias("_id"), F.col("label").alias("_label"), "two")
    told = told.join(best, told["id"].eqNullSafe(best["_id"]) & (told["label"] == best["_label"]), "left")
    hard = F.when(F.col("mode") == "max", F.col("top")).when(F.col("mode") == "top2", F.col("two")).otherwise(F.col("mean"))
    return told.select("id", "label", F.when(F.col("mode") == "mean", hard).otherwise((1 - mix) * hard + mix * F.col("soft")).alias("p"))


def masked_softmax_mean(values: Column, scores: Column, present: Column) -> Column:
    """Mean of an array weighted by the softmax of scores over the places that are present; null if none is."""
    kept = F.filter(F.arrays_zip(values.alias("v"), scores.alias("s"), present.alias("m")), lambda x: x["m"])
    top = F.array_max(F.transform(kept, lambda x: x["s"]))
    w = F.transform(kept, lambda x: F.exp(x["s"] - top))
    num = F.aggregate(F.zip_with(w, kept, lambda a, x: a * x["v"]), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(num, F.aggregate(w, F.lit(0.0), lambda s, v: s + v))
