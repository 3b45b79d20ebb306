"""A cache of rows by key, laid out in buckets of the key's hash, which jobs read through and fill at the same time."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..steps import delete, file_system
from . import commits


class KeyedCache:
    """Rows by key in a folder: one row for each key, whatever jobs add to it.

    Files are bucketed by the key, so a join by it reads the cache without a shuffle; only the keys that are asked for are
    shuffled, to its buckets. What a job adds is a version of its own, committed by the next number. A job that finds its
    number taken looks again at what is missing, drops the keys that others have added meanwhile, and takes the number
    after that; so no key comes twice, and a version without a number is never read. The number of buckets is fixed when
    the cache is made: with fewer than spark.sql.shuffle.partitions, Spark shuffles both sides after all.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", schema: StructType | None = None, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        layout = f"{self.path}/layout.json"
        if (told := commits.read_text(spark, layout)) is None:
            if schema is None:
                raise FileNotFoundError(f"no cache: {path}")
            buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
            commits.create(spark, layout, json.dumps({"key": key, "buckets": buckets, "schema": schema.json()}))
            told = commits.read_text(spark, layout)
        known = json.loads(told)
        self.key, self.buckets, self.schema = known["key"], known["buckets"], StructType.fromJson(json.loads(known["schema"]))
        self._told: set[str] = set()
        # a name for this folder in the session's catalogue; the files stay where they are
        self.name = f"cache_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, _version STRING) USING parquet PARTITIONED BY (_version) CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'")

    def versions(self) -> list[str]:
        """The committed versions, in the order of their numbers: a row for each job that added something."""
        return [json.loads(commits.read_text(self.spark, f"{self.path}/{commits.MARKERS}/{k}.json"))["version"] for k in commits.keys(self.spark, self.path)]

    def rows(self, versions: list[str] | None = None) -> DataFrame:
        """All rows, or those of some versions."""
        versions = self.versions() if versions is None else versions
        for v in [v for v in versions if v not in self._told]:  # the catalogue knows the versions that it is told of
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS PARTITION (_version = '{v}')")
            self._told.add(v)
        self.spark.catalog.refreshTable(self.name)
        own = self.spark.table(self.name).where(F.col("_version").isin(versions))
        return own.select(*self.schema.fieldNames())

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The wanted keys, once each, that the cache lacks. Null keys are never cached and never missing."""
        keys = wanted.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return keys.join(self.rows().select(self.key), self.key, "left_anti")

    def found(self, wanted: DataFrame) -> DataFrame:
        """The cache's rows of the wanted keys."""
        return self.rows().join(wanted.select(self.key).distinct(), self.key, "left_semi")

    def add(self, rows: DataFrame) -> int:
        """Add the rows whose keys the cache lacks, of equal keys one; returns the number of the version, or of the last one
        where nothing was left to add."""
        known = self.versions()
        new = rows.dropDuplicates([self.key]).where(F.col(self.key).isNotNull()).join(self.rows(known).select(self.key), self.key, "left_anti")
        mine = self._written(new)
        while True:
            if self.rows([mine]).isEmpty():
                delete(self.spark, f"{self.path}/data/_version={mine}")
                return len(known)
            if commits.create(self.spark, f"{self.path}/{commits.MARKERS}/{len(known) + 1:08d}.json", json.dumps({"version": mine})):
                return len(known) + 1
            # another job was first: what it added isn't ours to add
            latest = self.versions()
            rest = self.rows([mine]).join(self.rows([v for v in latest if v not in known]).select(self.key), self.key, "left_anti")
            before, mine, known = mine, self._written(rest), latest
            delete(self.spark, f"{self.path}/data/_version={before}")

    def _written(self, rows: DataFrame) -> str:
        """rows as a version that isn't committed yet, a file for each bucket. Each is written in a folder of its own, as jobs
        that write in one at a time clear each other's, and then moved to its place."""
        version, own = uuid.uuid4().hex, rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        stage = f"{self.path}/stage/{version}"
        own.repartition(self.buckets, self.key).write.format("parquet").bucketBy(self.buckets, self.key).option("path", stage).saveAsTable(f"stage_{version}")
        self.spark.sql(f"DROP TABLE stage_{version}")
        fs, at = file_system(self.spark, stage)
        _, place = file_system(self.spark, f"{self.path}/data/_version={version}")
        fs.mkdirs(place.getParent())
        if not fs.rename(at, place):
            raise OSError(f"can't move {stage}")
        return version

    def read_through(self, wanted: DataFrame, load: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of the wanted keys: `load` makes those that the cache lacks, which are added first."""
        lacking = self.missing(wanted)
        if not lacking.isEmpty():
            self.add(load(lacking))
        return self.found(wanted)
