"""Queries of the image source, the study worker, sinks and committed results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import studies
from ..sources import commits, dicom, images, readers, writers
from ..sources.caches import KeyedCache
from ..steps import shared_path
from . import base as B
from .queries import query

t = B.table

#: Vectors as images of 8 x 8 values: a study for each label, two series in it, a slice for each vector.
SLICES = """sl AS (SELECT label::VARCHAR AS study, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS series, vec_id, (vec_id * 37) % 11 AS z, embedding FROM embeddings)"""


def _slices(spark, d) -> DataFrame:
    e = t(spark, d, "embeddings")
    series = F.when(F.pmod("vec_id", F.lit(3)) == 0, "a").otherwise("b")
    zero = F.lit(0.0)
    pos = F.array(F.lit(-1.0), zero, F.pmod(F.col("vec_id") * 37, F.lit(11)).cast("double"))
    flat = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    side = F.when(F.pmod("label", F.lit(2)) == 0, "R").otherwise("L")
    return e.select(F.col("label").cast("string").alias("study"), series.alias("series"), F.col("vec_id").cast("int").alias("no"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), pos.alias("pos"), flat.alias("orient"), F.array(F.lit(1.0), F.lit(1.0)).alias("spacing"), side.alias("side"), F.col("embedding").cast("array<float>").alias("pixels"))


def _planes(slices: DataFrame) -> DataFrame:
    return slices.select("study", "series").distinct().withColumn("plane", F.when(F.col("series") == "a", "Sagittal").otherwise("coronal"))


def _scaled_sql(keys: str) -> str:
    """Slices in order, scaled and side-normalised: (study, series, place, n, x: values row by row)."""
    return f"""{SLICES},
u AS (SELECT study, series, unnest(embedding)::FLOAT AS x FROM sl),
q AS (SELECT study, series, quantile_cont(x::DOUBLE, 0.01) AS lo, quantile_cont(x::DOUBLE, 0.99) AS hi FROM u GROUP BY ALL),
o AS (SELECT study, series, embedding, row_number() OVER (PARTITION BY study, series ORDER BY z, vec_id) - 1 AS k0, count(*) OVER (PARTITION BY study, series) AS n FROM sl),
f AS (SELECT study, series, CASE WHEN series = 'a' AND study::INT % 2 = 0 THEN n - 1 - k0 ELSE k0 END AS place, n, unnest(range(0, 64)) AS i, embedding FROM o),
v AS (SELECT study, series, place, n, i, embedding[CASE WHEN series = 'b' AND study::INT % 2 = 0 THEN i - i % 8 + 7 - i % 8 ELSE i END + 1]::FLOAT AS x FROM f),
w AS (SELECT study, series, place, n, i, ((least(hi::FLOAT, greatest(lo::FLOAT, x)) - lo::FLOAT) / (hi - lo)::FLOAT)::FLOAT AS x FROM v JOIN q USING (study, series))"""


@query("WITH " + _scaled_sql("") + " SELECT study, series, place::INT AS place, n, i::INT AS i, round(x::DOUBLE, 5) AS x FROM w")
def arr04_volumes(spark, d):
    slices = _slices(spark, d)
    told, _ = studies.volume_slices(slices, _planes(slices), crop_mm=1000.0, size=8)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) for v in batch.column("data")]
            yield pa.record_batch([*(batch.column(c) for c in ("study", "series", "place", "n")), pa.array(x, pa.list_(pa.float64()))], names=["study", "series", "place", "n", "x"])

    each = told.mapInArrow(values, "study string, series string, place int, n long, x array<double>")
    return each.select("study", "series", "place", "n", F.posexplode("x").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("WITH " + _scaled_sql("") + """,
k AS (SELECT *, (n * 0.15)::DOUBLE AS a, (n * 0.85)::DOUBLE AS b FROM w), b AS (SELECT study, series, place, n, i, x, trunc(a)::INT AS lo, least(n, greatest(trunc(b)::INT, trunc(a)::INT + 3)) AS hi FROM k)
SELECT study, 'slot_' || series AS slot, (place - lo)::INT AS place, (any_value(hi) - lo)::INT AS n, string_agg(printf('%02X', trunc(x * 255::FLOAT)::INT), '' ORDER BY i) AS bytes FROM b WHERE place >= lo AND place < hi GROUP BY study, series, place, lo""")
def arr08_study_cache(spark, d):
    slices = _slices(spark, d)
    planes = _planes(slices)
    slots = planes.select("study", F.concat(F.lit("slot_"), "series").alias("slot"), "series")
    cache, _ = studies.study_cache(slices, planes, slots, crop_mm=1000.0, frame=8, size=8)
    return cache.select("study", "slot", "place", "n", F.hex("data").alias("bytes"))


def _saved(spark, d) -> str:
    """A folder of image files, one for each vector: <label>/<a or b>/<vec_id>."""
    root = shared_path(spark, "images")
    e = t(spark, d, "embeddings").select(F.col("label").cast("string").alias("study"), F.when(F.pmod("vec_id", F.lit(3)) == 0, "a").otherwise("b").alias("series"), F.format_string("%08d.dcm", "vec_id").alias("name"), F.col("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("v"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for k, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                fields = {"pos": f"0\\0\\{k}", "slope": "0.5", "intercept": "3"} if k % 2 else {"image_side": "L"}
                files.append(dicom.write(8, 8, np.array(v, np.int16), **fields) if k % 10 else b"broken")
            yield pa.record_batch([*(batch.column(c) for c in ("study", "series", "name")), pa.array(files, pa.binary())], names=["study", "series", "name", "content"])

    images.write_images(e.mapInArrow(made, "study string, series string, name string, content binary"), root)
    return root


@query("""SELECT label::VARCHAR AS study, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS series, printf('%08d', vec_id) AS file,
CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id % 2 = 1 THEN vec_id ELSE 0 END::DOUBLE AS z, CASE WHEN vec_id % 10 <> 0 AND vec_id % 2 = 0 THEN 'L' END AS side, vec_id % 10 = 0 AS failed FROM embeddings""")
def src10_geometry(spark, d):
    f = images.image_series(spark, _saved(spark, d), ["study", "series", "path", "pos", "side", "error"])
    return f.select("study", "series", F.regexp_extract("path", r"(\d+)\.dcm$", 1).alias("file"), F.get("pos", F.lit(2)).alias("z"), "side", F.col("error").isNotNull().alias("failed"))


@query("""SELECT label::VARCHAR AS study, printf('%08d', vec_id) AS file, i::INT AS i, CASE WHEN vec_id % 2 = 1 THEN floor(embedding[i + 1]::DOUBLE * 1000) * 0.5 + 3 ELSE floor(embedding[i + 1]::DOUBLE * 1000) END AS x
FROM embeddings, range(0, 64) r(i) WHERE vec_id % 10 <> 0""")
def src10_pixels(spark, d):
    fine, _ = images.readable(images.image_series(spark, _saved(spark, d), ["study", "series", "path", "pixels", "error"]))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) for v in batch.column("pixels")]
            yield pa.record_batch([batch.column("study"), batch.column("path"), pa.array(x, pa.list_(pa.float64()))], names=["study", "path", "x"])

    each = fine.select("study", "path", "pixels").mapInArrow(values, "study string, path string, x array<double>")
    return each.select("study", F.regexp_extract("path", r"(\d+)\.dcm$", 1).alias("file"), F.posexplode("x").alias("i", "x"))


@query("SELECT printf('%08d.dcm', vec_id) AS name, count(*) AS n FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0 GROUP BY 1")
def src17_find(spark, d):
    found = readers.find(spark, _saved(spark, d), "*[02468].dcm").where(F.col("path").contains("/a/"))
    return found.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("n"))


# sinks, written and read again


@query("SELECT o_orderkey::VARCHAR AS id, o_clerk AS text, o_orderpriority AS note FROM (SELECT o_orderkey, o_orderpriority, 'a \"quoted\", ' || o_orderstatus || chr(10) || 'line' AS o_clerk FROM orders)")
def snk05_csv(spark, d):
    path = shared_path(spark, "csv")
    text = F.concat(F.lit('a "quoted", '), "o_orderstatus", F.lit("\nline"))
    writers.write_csv(t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), F.col("o_orderpriority").alias("note")), path)
    return readers.csv(spark, path)


@query("SELECT o_orderstatus AS kind, count(*) * 1 AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def snk06_if_any(spark, d):
    o, path, none = t(spark, d, "orders"), shared_path(spark, "any"), shared_path(spark, "none")
    wrote = [writers.write_if_any(o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus"), path), writers.write_if_any(o.where("o_orderstatus = '?'").select("o_orderkey"), none)]
    if wrote != [True, False]:
        raise ValueError("an empty table was written, or a table with rows was not")
    return readers.csv(spark, path).groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS run, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def snk02_run_log(spark, d):
    """Rows of runs, appended once each: a run that is logged again, or by two jobs, has one row."""
    folder = shared_path(spark, "runs")
    means = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    for r in [*means.collect(), *means.collect()]:  # a row for each of five priorities
        commits.commit(means.where(F.col("run") == r.run), folder, "".join(c for c in r.run if c.isalnum()))
    return commits.everything(spark, folder)


@query("SELECT c_mktsegment AS segment, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def snk07_write_once(spark, d):
    path = shared_path(spark, "once")
    own = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))
    writers.write_once(own, path)
    return spark.read.schema(own.schema).json(path)


@query("SELECT documents.doc_id AS id, CASE WHEN labels.doc_id IS NULL THEN length(coalesce(text, '')) ELSE -1 END AS chars FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
def snk09_keyed_cache(spark, d):
    """Documents read through a cache that holds the labelled ones, twice: the second time nothing is missing."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    cache = KeyedCache(spark, shared_path(spark, "keyed"), "id", docs.schema)
    cache.add(t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("chars")))
    for _ in range(2):
        found = cache.read_through(docs.select("id"), lambda missing: docs.join(missing, "id", "left_semi"))
    if len(cache.versions()) != 2:
        raise ValueError("keys were loaded again")
    return found


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt07_missing_keys(spark, d):
    cached = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    cache = KeyedCache(spark, shared_path(spark, "keyed"), "id", cached.schema)
    cache.add(cached)
    return cache.missing(t(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'locked' ELSE 'working' END AS slice FROM labels")
def src08_split_file(spark, d):
    """A split file, written once and read again."""
    labels = t(spark, d, "labels")
    own = labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "locked").otherwise("working").alias("slice"))
    positives = labels.select(F.col("doc_id").cast("string").alias("id"), F.lit("quality").alias("label"), F.col("quality").alias("y"))
    path = shared_path(spark, "split")
    writers.write_once(writers.split_payload(own, positives, 2026), path)
    return readers.split_json(spark, path)
