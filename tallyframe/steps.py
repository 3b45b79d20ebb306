"""Steps of a job that are written and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Where each DataFrame of `written` is stored.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths that each open `cleared` deletes when it is left.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session without one gets a temporary folder."""
    global _own_dir
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage, and a lost executor can't make it come
    out otherwise. What was shuffled for it is deleted at once, not when the driver next collects its garbage."""
    path = shared_path(df.sparkSession, what)
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if _scopes:
        _scopes[-1].append(path)
    return out


#: Spark's setting that shuffle files go once the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete what `written` stores within, once this is left: what is lazy must have run by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def forget(*steps: DataFrame) -> None:
    """Delete what `written` stored for these, once nothing that is still to run reads them."""
    for df in steps:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path in it): any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)
