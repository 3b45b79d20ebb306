"""The keyed cache: layout, jobs at the same time, plans."""

import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import commits, readers
from tallyframe.sources.caches import KeyedCache


def made(spark, path, n=0, **more):
    rows = spark.range(n).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    cache = KeyedCache(spark, path, "id", rows.schema, **more)
    if n:
        cache.add(rows)
    return cache


def test_loads_what_is_missing_once(spark, tmp_path):
    cache, asked = made(spark, str(tmp_path / "c"), 3), []

    def load(missing):
        asked.append(sorted(r.id for r in missing.collect()))
        return missing.withColumn("v", F.lit("new"))

    wanted = spark.createDataFrame([(1,), (2,), (2,), (7,), (None,), (8,)], "id long")
    for _ in range(2):
        assert sorted(map(tuple, cache.read_through(wanted, load).collect())) == [(1, "v1"), (2, "v2"), (7, "new"), (8, "new")]
    assert asked == [[7, 8]] and cache.rows().count() == 5
    # another session's view of the same folder
    again = KeyedCache(spark, str(tmp_path / "c"))
    assert (again.key, again.buckets, again.rows().count(), len(again.versions())) == ("id", 64, 5, 2)
    # keys that are there, repeated or null add nothing
    assert again.add(spark.createDataFrame([(1, "x"), (None, "y"), (9, "a"), (9, "a")], "id long, v string")) == 3
    assert again.add(spark.createDataFrame([(1, "x")], "id long, v string")) == 3
    assert {r.id: r.v for r in again.rows().collect()} == {0: "v0", 1: "v1", 2: "v2", 7: "new", 8: "new", 9: "a"}


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = made(spark, str(tmp_path / "c"), 500)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wanted = spark.range(100, 900).toDF("id")
        for df in (cache.missing(wanted), cache.found(wanted)):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            own = plan.split("Initial Plan")[-1] if "Initial Plan" in plan else plan
            lines = own.splitlines()
            scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x)
            depth = len(re.match(r"[ :+\-*|]*", lines[scan])[0])
            # what stands above the scan: lines before it that are less indented, up to the join
            for x in reversed(lines[:scan]):
                own_depth = len(re.match(r"[ :+\-*|]*", x)[0])
                if own_depth < depth:
                    depth = own_depth
                    assert "Exchange" not in x, own
                    if "Join" in x:
                        break
        assert cache.missing(wanted).count() == 400 and cache.found(wanted).count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_jobs_at_the_same_time_add_each_key_once(spark, tmp_path):
    path = str(tmp_path / "c")
    made(spark, path)
    jobs = [spark.range(k * 10, k * 10 + 40).select("id", F.lit(f"job{k}").alias("v")) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda rows: KeyedCache(spark, path).add(rows), jobs))
    got = [tuple(r) for r in KeyedCache(spark, path).rows().collect()]
    assert sorted(i for i, _ in got) == list(range(70))
    assert all(int(v[3:]) * 10 <= i < int(v[3:]) * 10 + 40 for i, v in got)


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    cache = made(spark, str(tmp_path / "c"), 4)
    cache._written(spark.range(100, 110).select("id", F.lit("dead").alias("v")))  # a job that died before its commit
    assert cache.rows().count() == 4 and cache.missing(spark.range(100, 102).toDF("id")).count() == 2
    assert cache.add(spark.range(100, 103).select("id", F.lit("alive").alias("v"))) == 2
    assert {r.v for r in cache.found(spark.range(100, 110).toDF("id")).collect()} == {"alive"}
    assert commits.keys(spark, str(tmp_path / "c")) == ["00000001", "00000002"]


def test_array_caches_without_a_folder_or_with_a_bad_file(spark, tmp_path):
    rows = lambda *studies: spark.createDataFrame([(s, "A", [float(s)]) for s in studies], "study long, slot string, data array<double>")
    rows(1, 2).coalesce(1).write.parquet(str(tmp_path / "a"))
    rows(2, 3).write.parquet(str(tmp_path / "b"))
    (tmp_path / "b" / "part-99999-broken.parquet").write_bytes(b"no archive")
    with pytest.warns(UserWarning, match="missing"):
        got = readers.array_cache(spark, [str(tmp_path / x) for x in ("gone", "a", "b")]).collect()
    assert sorted((r.study, r.data) for r in got) == [(1, [1.0]), (2, [2.0]), (3, [3.0])]
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        readers.array_cache(spark, [str(tmp_path / "gone")])
