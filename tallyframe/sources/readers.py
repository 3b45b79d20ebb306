"""Sources: label, prediction and report tables, JSON results, image stacks and array caches."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import number, status_score
from ..operators.tables import keep_last, require, to_long
from ..steps import exists

#: The shape of an extraction response.
RESPONSE = "struct<language:string,labels:map<string,struct<status:string,evidence:string>>>"
STATUSES = ("affirmed", "negated", "uncertain", "not_mentioned")


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; without a schema every column is a string: ids are long digits, never numbers."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def ordered(df: DataFrame, order: str = "_ord") -> DataFrame:
    """df with a column that orders rows as the files hold them: file position, then row."""
    return df.withColumn(order, F.monotonically_increasing_id())


def studies(spark: SparkSession, path: str, labels: list[str], id_col: str, text_col: str) -> DataFrame:
    """A study table with its text and nullable labels."""
    df = require(csv(spark, path), [id_col, text_col, *labels])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("report"), *[number(F.col(f"`{x}`")).alias(x) for x in labels])


def gold_rows(df: DataFrame, labels: list[str], id_col: str = "id", order: str = "_ord") -> DataFrame:
    """Rows with every label, the last of each id."""
    own = df.select(F.col(id_col).cast("string").alias("id"), order, *[number(F.col(f"`{x}`")).alias(x) for x in labels])
    return keep_last(own.dropna(subset=labels), ["id"], [order]).drop(order)


def gold_mask(labels: list[str]):
    return F.forall(F.array(*[F.col(f"`{x}`") for x in labels]), lambda v: v.isNotNull())


def oof(df: DataFrame, labels: list[str], id_col: str = "id", truncate: bool = False) -> DataFrame:
    """(id, label, y, p) from {label}_true and {label}_pred; y is 1 from 0.5 on, or truncated to an integer."""
    require(df, [f"{x}{s}" for x in labels for s in ("_true", "_pred")])
    truth = to_long(df, id_col, labels, "y", "_true").join(to_long(df, id_col, labels, "p", "_pred"), ["id", "label"])
    y = F.col("y").cast("int") if truncate else F.coalesce(F.col("y") >= 0.5, F.lit(False)).cast("int")
    return truth.select("id", "label", y.alias("y"), F.coalesce("p", F.lit(0.5)).alias("p"))


def oof_last(df: DataFrame, labels: list[str], id_col: str = "id", order: str = "_ord", truncate: bool = False) -> DataFrame:
    """oof of the last row of each id; ids become strings. A file is read by ordered(csv(...))."""
    names = [f"`{x}{s}`" for x in labels for s in ("_true", "_pred")]
    require(df, [id_col, order, *[n.strip("`") for n in names]])
    last = keep_last(df.select(F.col(id_col).cast("string").alias("id"), order, *names), ["id"], [order])
    return oof(last, labels, truncate=truncate)


def teacher(df: DataFrame, labels: list[str], id_col: str = "id", order: str = "_ord") -> DataFrame:
    """(id, label, p) of the prediction columns alone, the last row of each id."""
    names = [f"{x}_pred" for x in labels]
    require(df, [id_col, *names])
    last = keep_last(df.select(F.col(id_col).cast("string").alias("id"), order, *[f"`{n}`" for n in names]), ["id"], [order])
    return to_long(last, "id", labels, "p", "_pred")


def json_results(files: DataFrame, engine: str) -> DataFrame:
    """(id, label, status, evidence, error, engine) from (file_ord, value), each value a JSON object of results by id.

    A status outside the vocabulary makes the whole result an error; the later file wins.
    """
    parsed = files.select("file_ord", F.explode(F.from_json("value", f"map<string,{RESPONSE}>")).alias("id", "r"))
    last = parsed.groupBy("id").agg(F.max_by("r", "file_ord").alias("r"))
    bad = F.get(F.filter(F.map_entries("r.labels"), lambda e: ~F.coalesce(e["value"]["status"], F.lit("")).isin(*STATUSES)), F.lit(0))
    error = F.when(F.col("bad").isNotNull(), F.concat(F.lit("bad status for "), F.col("bad.key"))).otherwise("")
    each = last.withColumn("bad", bad).select("id", error.alias("error"), F.explode("r.labels").alias("label", "v"))
    return each.select("id", "label", F.when(F.col("error") == "", F.col("v.status")).alias("status"), F.col("v.evidence").alias("evidence"), "error", F.lit(engine).alias("engine"))


def cached_results(cache: DataFrame, model: str, version: int) -> DataFrame:
    """(id, response, error) of cache rows (id, value) for this model and prompt version; malformed JSON is a miss."""
    got = cache.select("id", F.from_json("value", f"struct<model:string,prompt_version:int,response:{RESPONSE},error:string>").alias("c"))
    return got.where((F.col("c.model") == model) & (F.col("c.prompt_version") == version)).select("id", "c.response", "c.error")


def decoded(cached: DataFrame) -> DataFrame:
    """(id, language, label, status, score, evidence, error) of cached results: a row for each label, or one without a
    label where the result is an error, of unknown language."""
    fine = F.coalesce("error", F.lit("")) == ""
    language = F.when(fine, F.coalesce("response.language", F.lit("unk"))).otherwise("unk")
    each = cached.select("id", language.alias("language"), F.coalesce("error", F.lit("")).alias("error"), F.explode_outer(F.when(fine, F.col("response.labels"))).alias("label", "v"))
    evidence = F.when(F.col("label").isNotNull(), F.coalesce("v.evidence", F.lit("")))
    return each.select("id", "language", "label", F.col("v.status").alias("status"), status_score(F.col("v.status"), F.lit(False)).alias("score"), evidence.alias("evidence"), "error")


def uncached(ids: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    return ids if force else ids.join(cached.select("id"), "id", "left_anti")


def split_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, slice) of a split file."""
    df = spark.read.schema("version int, seed long, working array<string>, locked array<string>").option("multiLine", True).json(path)
    return df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).alias("ids")) for s in ("working", "locked")])).alias("s")).select(F.explode("s.ids").alias("id"), F.col("s.slice").alias("slice"))


def label_weights(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, w) for every label, 0.5 where the JSON object (value) has none."""
    given = weights.select(F.explode(F.from_json("value", "map<string,double>")).alias("label", "w"))
    return labels.select("label").join(F.broadcast(given), "label", "left").select("label", F.coalesce("w", F.lit(0.5)).alias("w"))


def array_cache(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(study, slot, shape, data) of Parquet caches in several folders; a study's first folder wins.

    A folder that is missing, and files that can't be read, are warned of and left out; without any folder it is an error.
    """
    from functools import reduce

    found = [(i, p) for i, p in enumerate(paths) if exists(spark, p)]
    for p in paths:
        if p not in [x for _, x in found]:
            warnings.warn(f"cache folder is missing: {p}", stacklevel=2)
    if not found:
        raise FileNotFoundError(f"no cache folder: {paths}")
    parts = [spark.read.option("ignoreCorruptFiles", True).parquet(p).withColumn("_dir", F.lit(i)) for i, p in found]
    every = reduce(DataFrame.unionByName, parts)
    first = every.groupBy("study").agg(F.min("_dir").alias("_dir"))
    return every.join(first, ["study", "_dir"]).drop("_dir")


def cached_slots(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """(study, slot, data) for the slots (study, slot, series) that a cache (study, key, data) holds: under the slot's
    name, or else under the id of its series, as older caches have it. Slots that it lacks are left out."""
    keys = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("slot").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("series").alias("key"))))
    tried = wanted.select("study", "slot", keys.alias("k")).select("study", "slot", "k.rank", "k.key")
    return tried.join(cache.select("study", "key", "data"), ["study", "key"]).groupBy("study", "slot").agg(F.min_by("data", "rank").alias("data"))


def read_through(wanted: DataFrame, path: str, load: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """Rows of a Parquet cache for the wanted keys: `load` makes those that it lacks, which are appended first.

    For plain Parquet folders that one job fills at a time: files of an append show up when its job is done, so a job that
    is run again after a failure loads only what is still missing. caches.KeyedCache serves jobs that run at once, and
    joins without shuffling the cache.
    """
    keys = wanted.select(key).distinct()
    load(keys.join(wanted.sparkSession.read.parquet(path).select(key), key, "left_anti")).write.mode("append").parquet(path)
    return wanted.sparkSession.read.parquet(path).join(keys, key, "left_semi")


def find(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path): files of a name anywhere under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
