"""Sinks: label, prediction and fold tables, run logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import strict_left, to_wide


def pseudo_labels(long: DataFrame, labels: list[str]) -> DataFrame:
    """(id, a column for each label, engine, language) from (id, label, score, engine, language)."""
    return long.groupBy("id", "engine", "language").pivot("label", labels).agg(F.first("score")).select("id", *[f"`{x}`" for x in labels], "engine", "language")


def submission(ids: DataFrame, predictions: DataFrame, labels: list[str]) -> DataFrame:
    """The predictions of each id in fixed column order, as they are; checked before anything is written."""
    return strict_left(ids.select("id"), predictions, "id", labels).select("id", *[f"`{x}`" for x in labels])


def oof_table(long: DataFrame, labels: list[str]) -> DataFrame:
    """{label}_true and {label}_pred columns with 6 decimals, from (id, label, y, p)."""
    wide = long.groupBy("id").pivot("label", labels).agg(F.first("y").alias("true"), F.first("p").alias("pred"))
    return wide.select("id", *[F.format_string("%.6f", F.col(f"`{x}_{s}`").cast("double")).alias(f"{x}_{s}") for x in labels for s in ("true", "pred")])


def run_row(spark: SparkSession, **fields) -> DataFrame:
    """One row of the run log: AUC with 8 decimals, minutes and cost with 2, per-label AUCs as JSON."""
    text = {k: "" if v is None else f"{v:.8f}" if k.endswith("auc") and isinstance(v, float) else f"{v:.2f}" if k in ("train_minutes", "cost_usd") else v for k, v in fields.items() if k != "per_label_auc"}
    row = spark.range(1).select(*[F.lit(str(v)).alias(k) for k, v in text.items()])
    maps = F.create_map(*[F.lit(x) for kv in (fields.get("per_label_auc") or {}).items() for x in kv]) if fields.get("per_label_auc") else None
    row = row.withColumn("per_label_auc", F.to_json(maps) if maps is not None else F.lit("{}"))
    return row.withColumn("created_at_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write a CSV if there are rows."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def write_once(df: DataFrame, path: str) -> None:
    """Write JSON; a path that exists is refused."""
    df.write.mode("errorifexists").json(path)


def split_payload(split: DataFrame, positives: DataFrame, seed: int, version: int = 1) -> DataFrame:
    """One row: version, seed, ids of either slice sorted, positives of each label in either slice."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("slice") == s, F.col("id")))).alias(s)
    ids = split.agg(of("working"), of("locked"))
    held = split.join(positives, "id").groupBy("slice", "label").agg(F.sum("y").alias("n"))
    counts = held.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(":", "slice", "label"), "n")))).alias("positive_counts"))
    return ids.crossJoin(counts).select(F.lit(version).alias("version"), F.lit(seed).alias("seed"), "working", "locked", "positive_counts")  # one row each


def corrections_report(result: dict[str, DataFrame]) -> DataFrame:
    """One row of JSON with the counts, thresholds, joint bands and drift of a round: a row for each label or pair."""
    listed = {k: result[k].agg(F.sort_array(F.collect_list(F.struct("*"))).alias(k)) for k in ("counts", "thresholds", "joint", "drift")}
    whole = listed["counts"]
    for k in ("thresholds", "joint", "drift"):
        whole = whole.crossJoin(listed[k])  # one row each
    return whole.select(F.to_json(F.struct("*")).alias("report"))


def restored(result: dict[str, DataFrame], original: DataFrame, labels: list[str], id_col: str) -> DataFrame:
    """original with its labels corrected, all other columns and the order of columns as they were."""
    new = to_wide(result["labels"], labels, "new").withColumnRenamed("id", id_col)
    return original.drop(*labels).join(new, id_col, "left").select(*[f"`{c}`" for c in original.columns])


def summary(counts: DataFrame) -> DataFrame:
    """A line of text for each label."""
    return counts.select("label", F.format_string("%-18s cand %5d  acc %5d  prev %.4f -> %.4f%s", "label", "candidates", "accepted", "prevalence_before", "prevalence_after", F.when(F.col("paused"), "  paused").otherwise("")).alias("line"))


def dtype_scaled(values: Column) -> Column:
    """Bytes 0..255 of a cached volume as 0..1."""
    return F.transform(values, lambda v: (v / F.lit(255.0)).cast("float"))
