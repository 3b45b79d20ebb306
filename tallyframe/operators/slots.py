"""Top child record for each slot rule of a parent: imaging series chosen by plane and contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values: (slot, plane, fluid sensitive, fat suppressed or any), in order.
SLOT_RULES = (
    ("SAG_FLUID_FS", "sagittal", 1, 1),
    ("COR_FLUID_FS", "coronal", 1, 1),
    ("AX_FLUID_FS", "axial", 1, 1),
    ("SAG_NOFS", "sagittal", 1, 0),
    ("COR_T1", "coronal", 0, None),
    ("SAG_T1", "sagittal", 0, None),
)


def rule_table(spark: SparkSession, rules=SLOT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "slot string, r_plane string, r_fluid int, r_fat int")


def slot_candidates(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of (study, series, plane, fluid, fat, n) that meet a rule: an equi-join on plane and fluid, and fat where
    the rule asks for it. The rule table is a handful of constants."""
    on = (F.trim(F.lower("plane")) == F.col("r_plane")) & (F.col("fluid") == F.col("r_fluid")) & (F.col("r_fat").isNull() | (F.col("fat") == F.col("r_fat")))
    return series.join(F.broadcast(rules), on)


def select_slots(series: DataFrame, rules: DataFrame) -> DataFrame:
    """(study, slot, series): for each study and slot the series with most slices, then the smallest id."""
    order = Window.partitionBy("study", "slot").orderBy(F.coalesce("n", F.lit(0)).desc(), "series")
    return slot_candidates(series, rules).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("study", "slot", "series")


def slot_table(series: DataFrame, rules: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each study of the input, with a column for each slot, null where it has no series.

    min_by over the candidates' order does what a window would, with partial aggregation before the one exchange.
    """
    names = names or [r[0] for r in SLOT_RULES]
    best = F.min_by("series", F.struct(-F.coalesce("n", F.lit(0)), F.col("series")))
    left = series.join(F.broadcast(rules), (F.trim(F.lower("plane")) == F.col("r_plane")) & (F.col("fluid") == F.col("r_fluid")) & (F.col("r_fat").isNull() | (F.col("fat") == F.col("r_fat"))), "left")
    return left.groupBy("study").pivot("slot", names).agg(best)
