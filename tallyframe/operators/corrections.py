"""Correcting noisy labels under prevalence and co-occurrence bands.

Long tables (id, label, cur, p): cur is the present soft label, p the teacher's probability; null cur counts as 0, null
p as 0.5. A pair table names labels that occur together: (first, second), a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import joint_band, number, prevalence_band
from ..steps import written
from .splits import places_within

#: Fixed values.
PAIRS = (("ACL", "Contusion"), ("Medial Meniscus", "Medial OA"), ("Lateral Meniscus", "Lateral OA"))
LOW_COUNT = 10
CODRIFT_RATIO, CODRIFT_LEAST = 2.0, 3
EPS = 1e-9


def prepared(rows: DataFrame) -> DataFrame:
    """(id, label, cur, p, given): numbers filled in, given = 1 where cur is at least 0.5."""
    cur, p = F.coalesce(number(F.col("cur")), F.lit(0.0)), F.coalesce(number(F.col("p")), F.lit(0.5))
    return rows.select("id", "label", cur.alias("cur"), p.alias("p"), (cur >= 0.5).cast("int").alias("given"))


def positive_counts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(label, n): positives of each label among some ids."""
    return rows.join(ids.select("id"), "id", "left_semi").groupBy("label").agg(F.count_if(F.col("cur") >= 0.5).alias("n"))


def thresholds(rows: DataFrame, weights: DataFrame, gold_positives: DataFrame, low_count: int = LOW_COUNT) -> DataFrame:
    """(label, threshold, origin): the mean prediction of a label's positives; with few gold positives, drawn towards
    the mean over labels weighted by w, the more the nearer w is to chance. Missing weights are 0.5."""
    own = rows.groupBy("label").agg(F.coalesce(F.avg(F.when(F.col("cur") >= 0.5, F.col("p"))), F.lit(0.5)).alias("e"))
    own = own.join(F.broadcast(weights), "label", "left").join(F.broadcast(gold_positives), "label", "left")
    own = own.select("label", "e", F.coalesce("w", F.lit(0.5)).alias("w"), F.coalesce("n", F.lit(0)).alias("n"))
    every = Window.partitionBy()  # a row for each label
    pooled = F.coalesce(F.try_divide(F.sum(F.col("e") * F.col("w")).over(every), F.sum("w").over(every)), F.avg("e").over(every))
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("w") - 0.5) / 0.5))
    few = F.col("n") < low_count
    return own.select("label", F.when(few, a * F.col("e") + (1 - a) * pooled).otherwise(F.col("e")).alias("threshold"), F.when(few, "pooled_backoff").otherwise("empirical").alias("origin"))


def candidates(rows: DataFrame, limits: DataFrame, least_class: int = 10) -> DataFrame:
    """rows with `flag`: labels that confident learning (Northcutt et al., 2021) takes for errors, one label at a time.

    A row is confidently of the class whose threshold its probability reaches (t for positives, 1 - t for negatives; the
    likelier of both). The confident counts of a given class, scaled to its size, say how many of its rows to prune:
    those with the largest margin of the other class, unless the prediction agrees with the label. A label with one
    class has none, and a class of `least_class` rows or fewer isn't pruned.
    """
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    t = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("threshold")))
    r = rows.join(F.broadcast(limits.select("label", "threshold")), "label").withColumns({"q": p, "t": t})
    sure = F.when((F.col("q") >= F.col("t")) & ((F.col("q") < F.col("t")) | (F.col("q") >= 1 - F.col("q"))), 1).when(1 - F.col("q") >= 1 - F.col("t"), 0).when(F.col("q") >= F.col("t"), 1)
    r = r.withColumn("sure", sure)
    counts = r.groupBy("label", "given").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sure") == 1 - F.col("given")).alias("off"), F.count_if(F.col("sure").isNotNull()).alias("all"))
    classes = F.count(F.lit(1)).over(Window.partitionBy("label"))
    prune = F.when((classes > 1) & (F.col("n") > least_class), F.bround(F.try_divide(F.col("off"), "all") * F.col("n"))).otherwise(0)
    counts = counts.select("label", "given", F.coalesce(prune, F.lit(0)).cast("long").alias("prune"))
    margin = F.when(F.col("given") == 1, 1 - 2 * F.col("q")).otherwise(2 * F.col("q") - 1)
    off = r.withColumn("_against", -margin).where("_against < 0").select("id", "label", "given", "_against")
    off = places_within(off, ["label", "given"], ["_against", "id"], "_r")
    off = off.join(F.broadcast(counts), ["label", "given"]).where("_r <= prune").select("id", "label", F.lit(True).alias("flag"))
    return rows.join(off, ["id", "label"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def bands(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(label, n, positives, low, high): bounds of each label's number of positives; missing weights are 0.5."""
    own = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("given").alias("positives")).join(F.broadcast(weights), "label", "left")
    low, high = prevalence_band(F.col("positives") / F.col("n"), F.coalesce("w", F.lit(0.5)))
    return own.select("label", "n", "positives", F.ceil(low * F.col("n") - EPS).alias("low"), F.floor(high * F.col("n") + EPS).alias("high"))


def capped(rows: DataFrame, limits: DataFrame, most: int | None = None) -> DataFrame:
    """rows (id, label, cur, p, given, flag) with `accepted`: flagged flips, the surest first, while the label's number
    of positives stays in its band; a flip that would leave it is passed over, and `most` of a label are accepted.

    The number of positives after a flip is the sum so far clamped to the band, and clamped sums compose: each range of
    the order is folded to one (shift, low, high), the few folds give each range's first state, and the ranges are then
    walked side by side. So no task holds a label's flips.
    """
    order = ["label", "_conf", "id"]
    step = F.when(F.col("given") == 0, 1).otherwise(-1)
    flips = rows.where("flag").join(F.broadcast(limits), "label").where("positives between low and high")
    flips = flips.select("id", "label", (-F.abs(F.col("p") - 0.5)).alias("_conf"), step.alias("step"), "low", "high", "positives")
    # written, as all uses must see the same ranges; read again, a range is in one task and in order
    flips = written(flips.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "flips")
    ranged = lambda rows: rows.repartition("_part").sortWithinPartitions("_part", *order)

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, list] = {}
        for f in frames:
            for part, label, s, low, high in zip(f["_part"], f["label"], f["step"], f["low"], f["high"], strict=True):
                c, a, b = state.get((part, label), (0, low, high))
                c, a, b = c + s, min(high, max(low, a + s)), min(high, max(low, b + s))
                state[part, label] = [c, a, b]
        yield pd.DataFrame([(p, x, *v) for (p, x), v in state.items()], columns=["_part", "label", "shift", "a", "b"])

    parts = ranged(flips).select("_part", "label", "step", "low", "high").mapInPandas(folded, "_part int, label string, shift long, a long, b long")
    held = parts.join(F.broadcast(limits.select("label", "positives")), "label").groupBy("label", "positives").agg(F.sort_array(F.collect_list(F.struct("_part", "shift", "a", "b"))).alias("ps"))
    first = F.struct(F.col("positives").cast("long").alias("x"), F.array().cast("array<struct<part:int,start:bigint>>").alias("out"))
    walked = F.aggregate("ps", first, lambda s, p: F.struct(F.least(p["b"], F.greatest(p["a"], s["x"] + p["shift"])).alias("x"), F.concat(s["out"], F.array(F.struct(p["_part"].alias("part"), s["x"].alias("start")))).alias("out")), lambda s: s["out"])
    starts = held.select("label", F.explode(walked).alias("s")).select("label", F.col("s.part").alias("_part"), F.col("s.start").alias("start"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple, int] = {}
        for f in frames:
            out = []
            for part, label, s, low, high, start in zip(f["_part"], f["label"], f["step"], f["low"], f["high"], f["start"], strict=True):
                x = at.get((part, label), start) + s
                ok = low <= x <= high
                at[part, label] = x if ok else x - s
                out.append(ok)
            yield f.assign(accepted=out)[["id", "label", "_conf", "accepted"]]

    kinds = dict(flips.dtypes)
    # sorted after the join: Spark drops a sort below one
    placed = ranged(flips.join(F.broadcast(starts), ["label", "_part"]))
    done = placed.select("_part", "id", "label", "_conf", "step", "low", "high", "start").mapInPandas(walk, f"id {kinds['id']}, label string, _conf double, accepted boolean").where("accepted")
    if most is not None:
        done = places_within(done, ["label"], ["_conf", "id"], "_r").where(F.col("_r") <= most)
    return rows.join(done.select("id", "label", "accepted"), ["id", "label"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def updated(rows: DataFrame) -> DataFrame:
    """rows with `new`: the opposite hard label where accepted."""
    return rows.withColumn("new", F.when(F.col("accepted"), 1.0 - F.col("given")).otherwise(F.col("cur")))


def pair_table(spark: SparkSession, pairs=PAIRS) -> DataFrame:
    return spark.createDataFrame(list(pairs), "first string, second string")


def paired(rows: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each id and pair, with a struct of the columns of either label; pairs with a missing label have none."""
    a = rows.join(F.broadcast(pairs), F.col("label") == F.col("first")).select("id", "first", "second", F.struct(*columns).alias("a"))
    b = rows.join(F.broadcast(pairs), F.col("label") == F.col("second")).select("id", "first", "second", F.struct(*columns).alias("b"))
    return a.join(b, ["id", "first", "second"])


def cooccurrence(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first, second, joint): share of ids positive in both."""
    return paired(rows, pairs, ["given"]).groupBy("first", "second").agg(F.avg((F.col("a.given") * F.col("b.given")).cast("double")).alias("joint"))


def enforce_joint_bands(rows: DataFrame, pairs: DataFrame, relative: float = 0.20) -> tuple[DataFrame, DataFrame]:
    """(rows, report): accepted flips revoked until each pair's joint rate is within its band around the rate before.

    Revoking one flip of an id changes the joint count by one at most, whichever of its two flips goes: each id offers
    its least sure flip that helps, and the least sure ids are revoked, as many as the count is off. Labels are in one
    pair at most.
    """
    both = paired(updated(rows), pairs, ["label", "given", "new", "accepted", "p"])
    on = lambda s: F.col(f"{s}.new") >= 0.5
    stat = both.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a.given") * F.col("b.given")).alias("before"), F.count_if(on("a") & on("b")).alias("after"))
    low, high = joint_band(F.col("before") / F.col("n"), relative)
    stat = stat.withColumns({"low": low, "high": high})
    n = F.col("n")
    over = F.greatest(F.lit(0), F.col("after") - F.floor(n * (F.col("high") + EPS)))
    under = F.greatest(F.lit(0), F.ceil(n * (F.col("low") - EPS)) - F.col("after"))
    stat = stat.withColumns({"over": over, "under": under})

    def offer(s: str, o: str, was: int):
        own = F.col(s)
        helps = own["accepted"] & (own["given"] == was) & on(o)
        return F.when(helps, F.struct(F.abs(own["p"] - 0.5).alias("conf"), own["label"].alias("label")))

    told = both.join(F.broadcast(stat.select("first", "second", "over", "under")), ["first", "second"]).where("over + under > 0")
    best = F.when(F.col("over") > 0, F.least(offer("a", "b", 0), offer("b", "a", 0))).otherwise(F.least(offer("a", "b", 1), offer("b", "a", 1)))
    told = told.withColumn("best", best).where("best is not null")
    offers = told.select("id", "first", "second", "best", (F.col("over") + F.col("under")).alias("_need"))
    gone = places_within(offers, ["first", "second"], ["best", "id"], "_r").where(F.col("_r") <= F.col("_need"))
    revoked = gone.groupBy("first", "second").agg(F.count(F.lit(1)).alias("revoked"))
    kept = rows.join(gone.select("id", F.col("best.label").alias("label"), F.lit(True).alias("_gone")), ["id", "label"], "left")
    kept = kept.withColumn("accepted", F.col("accepted") & F.col("_gone").isNull()).drop("_gone")
    report = stat.join(F.broadcast(revoked), ["first", "second"], "left").withColumn("revoked", F.coalesce("revoked", F.lit(0)))
    after = (F.col("after") + F.when(F.col("over") > 0, -F.col("revoked")).otherwise(F.col("revoked"))) / n
    report = report.select("first", "second", (F.col("before") / n).alias("baseline"), "low", "high", after.alias("after"), "revoked", after.between(F.col("low") - EPS, F.col("high") + EPS).alias("within"))
    return kept, report


def codrift(rows: DataFrame, pairs: DataFrame, ratio: float = CODRIFT_RATIO, least: int = CODRIFT_LEAST) -> DataFrame:
    """(first, second, n_a, n_b, joint, expected, ratio, flagged): whether flips of a pair coincide more than by chance."""
    hit = paired(rows, pairs, ["accepted"]).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"), F.count_if("a.accepted").alias("n_a"), F.count_if("b.accepted").alias("n_b"), F.count_if(F.col("a.accepted") & F.col("b.accepted")).alias("joint"))
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.col("n")
    hit = hit.withColumn("expected", expected)
    value = F.when(F.col("expected") > 0, F.try_divide("joint", "expected")).when(F.col("joint") > 0, F.lit(float("inf"))).otherwise(0.0)
    return hit.withColumn("ratio", value).select("first", "second", "n_a", "n_b", "joint", "expected", "ratio", ((F.col("joint") >= least) & (F.col("ratio") >= ratio)).alias("flagged"))


def run_corrections(rows: DataFrame, weights: DataFrame, gold: DataFrame, pairs: DataFrame, most: int | None = None, identity: bool = False, positives: DataFrame | None = None) -> dict[str, DataFrame]:
    """A round of corrections: labels (id, label, cur, new, accepted, paused) and the reports of each step.

    gold: (id) of rows never corrected, whose positives also say which labels have few, unless positives (label, n) do.
    identity: a round that changes nothing. Both labels of a pair whose flips drift together get their old values back.
    """
    base = written(prepared(rows), "prepared")
    limits = bands(base, weights)
    cuts = thresholds(base, weights, positive_counts(base, gold) if positives is None else positives)
    if identity:
        flagged = base.withColumn("flag", F.lit(False))
    else:
        flagged = candidates(base, cuts).join(gold.select("id", F.lit(True).alias("_gold")).distinct(), "id", "left").withColumn("flag", F.col("flag") & F.col("_gold").isNull()).drop("_gold")
    done = written(capped(flagged, limits, most), "capped")
    kept, joint = enforce_joint_bands(done, pairs)
    drift = codrift(kept, pairs)
    paused = drift.where("flagged").select(F.explode(F.array("first", "second")).alias("label"), F.lit(True).alias("paused")).distinct()
    out = kept.join(F.broadcast(paused), "label", "left").withColumn("paused", F.coalesce("paused", F.lit(False)))
    out = updated(out.withColumn("accepted", F.col("accepted") & ~F.col("paused")))
    counts = out.groupBy("label").agg(F.avg("given").alias("prevalence_before"), F.avg((F.col("new") >= 0.5).cast("double")).alias("prevalence_after"), F.count_if("flag").alias("candidates"), F.count_if("accepted").alias("accepted"), F.max("paused").alias("paused"))
    return {"labels": out.select("id", "label", "cur", "new", "accepted", "paused"), "counts": counts, "thresholds": cuts, "joint": joint, "drift": drift}
