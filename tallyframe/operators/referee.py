"""Accepting or rejecting a round of label corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import auc_by, bootstrap_agreement

#: Fixed values.
TRUSTED = ("ACL", "MCL", "Medial Meniscus", "Lateral Meniscus", "Baker's", "Fracture")
GAP = ("Effusion", "Synovitis", "Medial OA", "Lateral OA", "PF OA", "Contusion")
MACRO_FLOOR, LABEL_FLOOR, SMOKE_ALARM = 0.003, 0.01, -0.10
DRAWS, AGREEMENT, EFFECT, EVERY, MAX_ROUNDS = 3000, 0.90, 0.02, 2, 3


def partition_faults(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, groups, known): labels that aren't in exactly one of the groups (group, label), or that no one knows
    (labels: label). Empty if the groups are disjoint and cover the labels."""
    told = groups.select("label", "group", F.lit(False).alias("known")).union(labels.select("label", F.lit(None).cast(groups.schema["group"].dataType), F.lit(True)))
    each = told.groupBy("label").agg(F.count_distinct("group").alias("groups"), F.max("known").alias("known"))
    return each.where("groups <> 1 or not known")


def auc_deltas(scores: DataFrame, own_truth: bool = True) -> DataFrame:
    """(label, prev_auc, new_auc, delta) from (id, label, y, y_new, prev, new), for labels with both classes in both.

    own_truth: each side is scored against its own truth; otherwise both against y.
    """
    sides = F.explode(F.array(F.struct(F.lit("prev").alias("which"), F.col("y").alias("y"), F.col("prev").alias("p")), F.struct(F.lit("new").alias("which"), F.col("y_new" if own_truth else "y").alias("y"), F.col("new").alias("p"))))
    long = scores.select("label", sides.alias("s")).select("label", "s.which", "s.y", F.coalesce("s.p", F.lit(0.5)).alias("p"))
    each = auc_by(long, ["label", "which"]).groupBy("label").agg(F.max(F.when(F.col("which") == "prev", F.col("auc"))).alias("prev_auc"), F.max(F.when(F.col("which") == "new", F.col("auc"))).alias("new_auc"))
    return each.where("prev_auc is not null and new_auc is not null").withColumn("delta", F.col("new_auc") - F.col("prev_auc"))


def cv_gate(deltas: DataFrame, trusted: tuple[str, ...] = TRUSTED, macro_floor: float = MACRO_FLOOR, label_floor: float = LABEL_FLOOR) -> DataFrame:
    """One row: macro_prev, macro_new, macro_delta, degraded, accepted, advisory.

    Only trusted labels decide: their mean must gain macro_floor, and none may lose more than label_floor. The other
    labels' changes are told in `advisory`. Without a trusted label the query fails.
    """
    own = F.col("label").isin(*trusted)
    out = deltas.agg(
        F.avg(F.when(own, F.col("prev_auc"))).alias("macro_prev"),
        F.avg(F.when(own, F.col("new_auc"))).alias("macro_new"),
        F.sort_array(F.collect_list(F.when(own & (F.col("delta") < -label_floor), F.col("label")))).alias("degraded"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(~own, F.struct("label", "delta"))))).alias("advisory"),
        F.count_if(own).alias("n"),
    )
    out = out.withColumn("macro_delta", F.when(F.col("n") > 0, F.col("macro_new") - F.col("macro_prev")).otherwise(F.raise_error(F.lit("no trusted label is scorable on both sides")).cast("double")))
    return out.withColumn("accepted", (F.col("macro_delta") >= macro_floor) & (F.size("degraded") == 0)).drop("n")


def gold_check(scores: DataFrame, round_index: int, every: int = EVERY, draws: int = DRAWS, agreement: float = AGREEMENT, effect: float = EFFECT, force: bool = False) -> DataFrame:
    """One row: ran, macro_delta, agreement, signal, veto. It can only veto, on a clear loss; and only every few rounds.

    scores: (id, label, y, prev, new) of the working gold slice.
    """
    if not force and not (every > 0 and round_index > 0 and round_index % every == 0):
        return scores.sparkSession.range(1).select(F.lit(False).alias("ran"), F.lit(None).cast("double").alias("macro_delta"), F.lit(None).cast("double").alias("agreement"), F.lit("skipped").alias("signal"), F.lit(False).alias("veto"))
    each = bootstrap_agreement(scores, draws).where("point is not null").agg(F.avg("point").alias("macro_delta"), F.avg("agreement").alias("agreement"))
    sure = F.col("agreement") >= agreement
    signal = F.when(sure & (F.col("macro_delta") >= effect), "positive").when(sure & (F.col("macro_delta") <= -effect), "negative").otherwise("inconclusive")
    return each.select(F.lit(True).alias("ran"), "macro_delta", "agreement", signal.alias("signal"), F.coalesce(signal == "negative", F.lit(False)).alias("veto"))


def final_check(scores: DataFrame, unlock: bool = False, draws: int = DRAWS, floor: float = SMOKE_ALARM) -> DataFrame:
    """One row on the locked slice: an alarm for a large loss, never a confirmation."""
    if not unlock:
        raise PermissionError("the locked slice is read once, with unlock=True")
    each = bootstrap_agreement(scores, draws).where("point is not null").agg(F.avg("point").alias("macro_delta"), F.avg("agreement").alias("agreement"))
    return each.select("macro_delta", "agreement", F.when(F.col("macro_delta") < floor, "negative").otherwise("inconclusive").alias("signal"), (F.col("macro_delta") < floor).alias("veto"))


def stop_decisions(rounds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """rounds (round, accepted, veto, and what tells them apart) with stop, rollback and reason."""
    cap = F.col("round") >= max_rounds
    bad = ~F.col("accepted") | F.col("veto")
    reason = F.when(~F.col("accepted"), "cv gate rejected").when(F.col("veto"), "gold check strong negative").when(cap, f"round cap reached ({max_rounds} rounds)").otherwise("accepted; continue")
    return rounds.withColumns({"stop": bad | cap, "rollback": bad, "reason": reason})


def stop_decision(gate: DataFrame, gold: DataFrame | None, round_index: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One row: stop, rollback, reason."""
    # one row each
    both = gate.select("accepted").crossJoin(gold.select("veto")) if gold is not None else gate.select("accepted", F.lit(False).alias("veto"))
    return stop_decisions(both.withColumn("round", F.lit(round_index)), max_rounds).select("stop", "rollback", "reason")
