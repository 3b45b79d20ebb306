"""Joins, overrides and checks between tables of labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import placed


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order): each key with its first place."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def to_long(df: DataFrame, id_col: str, labels: list[str], value: str = "p", suffix: str = "") -> DataFrame:
    """(id, label, value) from a column for each label."""
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{x}{suffix}`").cast("double").alias(value)) for x in labels])
    return df.select(F.col(id_col).alias("id"), F.explode(pairs).alias("_s")).select("id", "_s.label", f"_s.{value}")


def to_wide(df: DataFrame, labels: list[str], value: str = "p") -> DataFrame:
    """A column for each label, from (id, label, value)."""
    return df.groupBy("id").pivot("label", labels).agg(F.first(value))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def strict_left(ids: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """ids with the columns of `found`; an id without a row there fails the query when it is read."""
    joined = ids.join(found.select(key, *columns, F.lit(True).alias("_found")), key, "left")
    check = lambda c: F.when(F.col("_found"), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))))
    return joined.select(*ids.columns, *[check(c).alias(c) for c in columns])


def aligned(prev: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that both have, with the columns of either under the prefixes prev_ and new_."""
    a = prev.select(key, *[F.col(c).alias(f"prev_{c}") for c in columns])
    b = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return a.join(b, key)


def aligned_in_order(left: DataFrame, right: DataFrame, key: str, labels: list[str], order: str, right_order: str) -> DataFrame:
    """(place, key, a column for each label, {label}_pred): the rows of left, in its order, whose key right has.

    A key has the values of its last row on either side; a key that left repeats keeps all its places. Keys are strings.
    """
    preds = [f"{x}_pred" for x in labels]
    require(left, [key, order, *labels])
    require(right, [key, right_order, *preds])
    as_text = F.col(key).cast("string").alias(key)
    a = keep_last(left.select(as_text, order, *[f"`{x}`" for x in labels]), [key], [order]).drop(order)
    b = keep_last(right.select(as_text, F.col(right_order).alias("_ro"), *[f"`{x}`" for x in preds]), [key], ["_ro"]).drop("_ro")
    rows = left.select(as_text, F.col(order).alias("_o")).join(b, key).join(a, key)
    return placed(rows, ["_o"], "place").select("place", key, *[f"`{x}`" for x in [*labels, *preds]])


def overridden(pseudo: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """gold's rows, and those of pseudo that gold has no row for."""
    return pseudo.join(gold.select(key), key, "left_anti").unionByName(gold)


def merged(rules: DataFrame, model: DataFrame) -> DataFrame:
    """(id, label, status, score, engine) from two engines: the model's row where there is one without an error."""
    m = model.select("id", "label", F.struct("status", "score", "error").alias("m"))
    use = F.col("m").isNotNull() & (F.coalesce(F.col("m.error"), F.lit("")) == "")
    pick = lambda c: F.when(use, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c)
    return rules.join(m, ["id", "label"], "left").select("id", "label", pick("status"), pick("score"), F.when(use, "model").otherwise("rules").alias("engine"))


def disagreements(rules: DataFrame, model: DataFrame) -> DataFrame:
    """(id, label, rules_status, model_status) where two engines differ and the model has no error."""
    m = model.where(F.coalesce("error", F.lit("")) == "").select("id", "label", F.col("status").alias("model_status"))
    both = rules.select("id", "label", F.col("status").alias("rules_status")).join(m, ["id", "label"])
    return both.where("rules_status <> model_status")


def audit(rules: DataFrame, model: DataFrame) -> DataFrame:
    """disagreements with their place in the order by label and id, both as text."""
    rows = disagreements(rules, model).withColumn("id", F.col("id").cast("string"))
    return placed(rows, ["label", "id"], "place")


def left_default(df: DataFrame, names: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """df with the value that `names` has for the key, else a default."""
    return df.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(same): whether two tables have the same set of ids."""
    sides = a.select(key, F.lit(1).alias("x")).union(b.select(key, F.lit(2).alias("x"))).distinct()
    each = sides.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.min("n") == 2, F.lit(True)).alias("same"))


def locked_guard(ids: DataFrame, locked: DataFrame, key: str, unlock: bool = False) -> DataFrame:
    """ids, but an id that is locked fails the query when it is read, unless unlocked."""
    if unlock:
        return ids
    hit = locked.select(key, F.lit(True).alias("_locked")).distinct()
    marked = ids.join(hit, key, "left")
    guard = F.when(F.col("_locked"), F.raise_error(F.concat(F.lit("locked id: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return marked.where(guard).drop("_locked")
