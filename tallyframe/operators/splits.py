"""Cross-validation folds, shards and stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import group_key, hash_fold
from ..steps import written

#: Patterns of labels that a stratified split tells apart: 13 labels make fewer.
PATTERNS = 10_000


def cv_splits(studies: DataFrame, folds: int, seed: int | str = 42, study: str = "study", patient: str = "patient", site: str = "site", language: str = "language") -> DataFrame:
    """studies with `fold`, the same for all studies of a patient, site and language: a projection, without a shuffle."""
    at = lambda c: F.col(c) if c in studies.columns else None
    key = group_key(F.col(study), F.col(patient) if patient in studies.columns else F.lit(""), at(site), at(language))
    return studies.withColumn("fold", hash_fold(key, folds, seed))


def leaks(folds: DataFrame, group: str) -> DataFrame:
    """(group, folds): groups that are in more than one fold; empty when nothing leaks."""
    return folds.groupBy(group).agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def group_leaks(folds: DataFrame, train: DataFrame, study: str = "study", patient: str = "patient") -> DataFrame:
    """leaks of patients, from a table of folds by study and one of patients by study. Studies without a fold are left
    out; one without a patient is a patient of its own."""
    own = F.coalesce(F.nullif(F.col(patient).cast("string"), F.lit("")), F.col(study).cast("string"))
    return leaks(train.select(study, own.alias(patient)).join(folds.select(study, "fold"), study), patient)


def placed(rows: DataFrame, order: list, out: str) -> DataFrame:
    """rows with their place, from 0, in an order by columns.

    Rows are dealt out by ranges and numbered in each; a range's offset is the sum of the counts before it, a row for
    each range. So no task sorts all rows. The numbered ranges are written, as both uses must see the same ones.
    """
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(counts), "_part").select(*rows.columns, (F.col("_before") + place).alias(out))


def places_within(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """rows with their place, from 1, among those of their keys, few of which there are. Places come from ranges of the
    whole order, so a key with most of the rows isn't one task."""
    numbered = placed(rows, [*keys, *order], "_place")
    first = numbered.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return numbered.join(F.broadcast(first), keys).withColumn(out, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def sorted_index(keys: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct keys with their place, from 0, in sorted order."""
    return placed(keys.select(key).distinct(), [key], out)


def round_robin(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """df with the place of its key among the sorted distinct keys, modulo n: shards of studies, folds of patients."""
    return df.join(sorted_index(df, key, out).withColumn(out, F.pmod(out, F.lit(n)).cast("int")), key)


def multiplicity(studies: DataFrame, patient: str) -> DataFrame:
    """One row: studies, patients, patients with several studies, most studies of one, studies without a patient."""
    known = studies.where(F.coalesce(F.col(patient).cast("string"), F.lit("")) != "")
    each = known.groupBy(patient).agg(F.count(F.lit(1)).alias("n"))
    of_patients = each.agg(F.count(F.lit(1)).alias("patients"), F.count_if(F.col("n") > 1).alias("with_several"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    blank = F.count_if(F.coalesce(F.col(patient).cast("string"), F.lit("")) == "")
    return studies.agg(F.count(F.lit(1)).alias("studies"), blank.alias("without")).crossJoin(F.broadcast(of_patients))  # one row each


def stratified_split(rows: DataFrame, labels: list[str], capacity: int, seed: int = 2026, key: str = "id") -> DataFrame:
    """(id, slice): `capacity` rows locked, the others working, with each label's positives spread in proportion.

    Rows are counted by the pattern of their labels, positive from 0.5 on. Each pattern gets its share of the capacity, rounded down; each seat
    left over goes to the pattern that brings the labels' positives nearest to their targets, of equal ones to that with
    the largest remainder. In each pattern, the first rows by a hash of seed and id are locked. The driver holds a row
    for each pattern, PATTERNS at most, more are an error; places come from ranges, so no task reads all rows. A null label
    counts as not positive.
    """
    pattern = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("double") >= 0.5, F.lit(False)).cast("int").cast("string") for c in labels])
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    own = rows.select(F.col(key).cast("string").alias("id"), pattern.alias("_pattern"), order.alias("_order"))
    numbered = placed(own, ["_pattern", "_order", "id"], "_at")
    counts = sorted(tuple(r) for r in numbered.groupBy("_pattern").agg(F.count(F.lit(1)), F.min("_at")).limit(PATTERNS + 1).collect())
    if len(counts) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns of labels")
    seats = shares([[float(v) for v in p.split("|")] for p, _, _ in counts], [n for _, n, _ in counts], capacity)
    ends = rows.sparkSession.createDataFrame([(p, at + k) for (p, _, at), k in zip(counts, seats, strict=True)], "_pattern string, _end long")
    return numbered.join(F.broadcast(ends), "_pattern").select("id", F.when(F.col("_at") < F.col("_end"), "locked").otherwise("working").alias("slice"))


def shares(patterns: list[list[float]], counts: list[int], capacity: int) -> list[int]:
    """How many rows of each pattern of labels are locked: in proportion to its count, `capacity` in all at most."""
    n = sum(counts)
    take = min(capacity, n)
    if not take:
        return [0] * len(counts)
    quota = [divmod(c * take, n) for c in counts]
    seats, rest = [q for q, _ in quota], [r for _, r in quota]
    target = [sum(p[k] * c for p, c in zip(patterns, counts, strict=True)) * take / n for k in range(len(patterns[0]))]
    have = [sum(p[k] * s for p, s in zip(patterns, seats, strict=True)) for k in range(len(target))]
    for _ in range(take - sum(seats)):

        def cost(i: int) -> tuple:
            off = sum((h + x - t) ** 2 / max(t, 1e-6) for h, x, t in zip(have, patterns[i], target, strict=True))
            return round(off, 9), -rest[i], i

        best = min((i for i in range(len(counts)) if rest[i] and seats[i] == quota[i][0]), key=cost)
        seats[best] += 1
        have = [h + x for h, x in zip(have, patterns[best], strict=True)]
    return seats
