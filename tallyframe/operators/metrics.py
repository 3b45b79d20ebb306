"""Agreement of scores with truth, for each label of long tables (id, label, y, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bce
from .bootstrap import bootstrap_agreement
from .ranks import joined, running_total


__all__ = ["accuracy", "auc_by", "bootstrap_agreement", "collapsed", "evaluated", "macro", "scorable", "weighted_loss"]


def auc_by(scores: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(keys, n_pos, n_neg, auc): area under the ROC curve with ties counted half; null where a class is missing.

    Rows are first counted by score, combined on the map side however few labels there are; the counts are then summed
    along the order of scores (running_total), so that a label of very many distinct scores isn't one task.
    """
    counts = scores.groupBy(*keys, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    won = running_total(counts, keys, [p], "neg", "below").withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    total = won.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.select(*keys, "n_pos", "n_neg", F.when(pairs > 0, F.col("won") / pairs).alias("auc"))


def macro(aucs: DataFrame) -> DataFrame:
    """One row: the mean over labels that have an AUC, their number, and the map of all of them."""
    known = aucs.where("auc is not null")
    return known.agg(F.avg("auc").alias("macro_auc"), F.count(F.lit(1)).alias("n_labels"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "auc")))).alias("per_label"))


def scorable(scores: DataFrame) -> DataFrame:
    """(label): labels of which both classes are present."""
    return scores.groupBy("label").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a <> b").select("label")


def accuracy(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.groupBy("label").agg(F.avg(((F.col("p") >= threshold) == (F.col("y") == 1)).cast("double")).alias("accuracy"))


def evaluated(gold: DataFrame, pseudo: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, n, accuracy, auc, macro_auc): pseudo labels (id, label, p) against gold ones (id, label, y).

    Gold rows without a pseudo label don't count, nor does an AUC of one class in the macro AUC, which is the same on
    every row.
    """
    both = gold.select("id", "label", "y").where("y is not null").join(pseudo.select("id", "label", "p"), ["id", "label"])
    right = ((F.col("p") >= threshold) == (F.col("y") == 1)).cast("double")
    each = joined(both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy")), auc_by(both, ["label"]).select("label", "auc"), ["label"])
    return each.crossJoin(F.broadcast(each.agg(F.avg("auc").alias("macro_auc"))))  # one row


def weighted_loss(logit: Column, y: Column, weight: Column) -> Column:
    """Aggregate: weighted mean of the cross entropy; rows of weight 0 don't count."""
    return F.sum(weight * bce(logit, y)) / F.greatest(F.sum(weight), F.lit(1e-8))


def collapsed(scores: DataFrame, least: float = 0.01) -> DataFrame:
    """One row: the largest population variance of any label's predictions, and whether it exceeds `least`."""
    each = scores.groupBy("label").agg(F.var_pop("p").alias("v"))
    return each.agg(F.max("v").alias("max_variance"), (F.max("v") > least).alias("passes"))
