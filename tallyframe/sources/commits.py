"""Results that are committed once: a job that runs twice, or two at a time, leave one result.

Data are written to a folder of their own; a marker file then names that folder. A marker is created only if there is none
of its name, so of two writers one wins, and the other takes up the winner's data and deletes its own. Readers see what
markers name, never a half-written folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..steps import delete, file_system

MARKERS = "_commits"


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if there is none."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small text file; False if there is one of this name already. The text shows up whole: it is written beside
    and renamed."""
    fs, at = file_system(spark, path)
    if fs.exists(at):
        return False
    fs.mkdirs(at.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    # the name is claimed by a file that only one can create; what it says follows by the rename
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.claim")
    try:
        fs.create(claim, False).close()
    except Exception:  # noqa: BLE001  another writer has it
        if fs.exists(at) or not _stale(spark, fs, claim):
            fs.delete(beside, False)
            return False
    done = fs.rename(beside, at)
    fs.delete(claim, False)
    return bool(done)


#: Milliseconds after which a claim without its marker is of a writer that died.
STALE = 60_000


def _stale(spark: SparkSession, fs, claim) -> bool:
    import time

    for _ in range(50):  # the other writer is between its claim and its rename
        if not fs.exists(claim):
            return False
        if time.time() * 1000 - fs.getFileStatus(claim).getModificationTime() > STALE:
            return True
        time.sleep(0.1)
    return False


def commit(df: DataFrame, folder: str, key: str) -> DataFrame:
    """df under a key of a folder, written once: if the key is there already, what it has is read instead of df."""
    spark = df.sparkSession
    marker = f"{folder}/{MARKERS}/{key}.json"
    if read_text(spark, marker) is None:
        data = f"{folder}/{key}-{uuid.uuid4().hex}"
        df.write.parquet(data)
        if not create(spark, marker, json.dumps({"key": key, "data": data.rsplit("/", 1)[1], "schema": df.schema.json()})):
            delete(spark, data)
    return committed(spark, folder, key)


def committed(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """What a key of a folder has, or None."""
    from pyspark.sql.types import StructType

    text = read_text(spark, f"{folder}/{MARKERS}/{key}.json")
    if text is None:
        return None
    told = json.loads(text)
    return spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).parquet(f"{folder}/{told['data']}")


def keys(spark: SparkSession, folder: str) -> list[str]:
    """The committed keys of a folder, sorted: a row for each job that wrote to it."""
    fs, at = file_system(spark, f"{folder}/{MARKERS}")
    if not fs.exists(at):
        return []
    return sorted(n.removesuffix(".json") for f in fs.listStatus(at) if (n := f.getPath().getName()).endswith(".json"))


def everything(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all keys of a folder, which have one schema; None if it has no key."""
    found = [json.loads(read_text(spark, f"{folder}/{MARKERS}/{k}.json")) for k in keys(spark, folder)]
    if not found:
        return None
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(json.loads(found[0]["schema"]))).parquet(*[f"{folder}/{t['data']}" for t in found])
