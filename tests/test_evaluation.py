"""Caches, order of joins, groups of labels and windows on small rows, odd ones among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.text import LABELS
from tallyframe.operators import metrics, referee, splits, tables
from tallyframe.operators import windows as W
from tallyframe.sources import readers


def test_read_through_loads_what_is_missing_once(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []
    spark.createDataFrame([(1, "old")], "id long, v string").write.parquet(path)

    def load(missing):
        asked.append(sorted(r.id for r in missing.collect()))
        return missing.withColumn("v", F.lit("new"))

    wanted = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    for _ in range(2):
        assert sorted(map(tuple, readers.read_through(wanted, path, load).collect())) == [(1, "old"), (2, "new"), (3, "new")]
    assert asked == [[2, 3], []]


def test_slots_are_cached_under_their_name_or_their_series(spark):
    cache = spark.createDataFrame([(1, "S0", [1.0]), (1, "u1", [2.0]), (2, "u2", [3.0])], "study long, key string, data array<double>")
    wanted = spark.createDataFrame([(1, "S0", "u1"), (1, "S1", "u1"), (2, "S0", "u2"), (2, "S1", None), (3, "S0", "u9")], "study long, slot string, series string")
    assert {(r.study, r.slot): r.data for r in readers.cached_slots(cache, wanted).collect()} == {(1, "S0"): [1.0], (1, "S1"): [2.0], (2, "S0"): [3.0]}


def test_oof_of_a_file_keeps_last_rows(spark, tmp_path):
    (tmp_path / "oof.csv").write_text("id,A_true,A_pred\n007,1.0,0.2\n8,0,0.4\n007,0.0,0.9\n")
    got = readers.oof_last(readers.ordered(readers.csv(spark, str(tmp_path / "oof.csv"))), ["A"])
    assert sorted(map(tuple, got.collect())) == [("007", "A", 0, 0.9), ("8", "A", 0, 0.4)]
    with pytest.raises(ValueError):
        readers.oof_last(spark.createDataFrame([("x", 1)], "id string, _ord int"), ["A"])


def test_join_in_left_order_repeats_last_values(spark):
    left = spark.createDataFrame([("b", 1, 0.1), ("a", 2, 0.2), ("z", 3, 0.3), ("b", 4, 0.4)], "id string, at int, A double")
    right = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0), ("b", 3, 7.0)], "id string, at int, A_pred double")
    got = tables.aligned_in_order(left, right, "id", ["A"], "at", "at").orderBy("place").collect()
    assert list(map(tuple, got)) == [(0, "b", 0.4, 7.0), (1, "a", 0.2, 5.0), (2, "b", 0.4, 7.0)]
    with pytest.raises(ValueError):
        tables.aligned_in_order(left, right.drop("A_pred"), "id", ["A"], "at", "at")


def test_trusted_and_gap_labels_are_a_partition(spark):
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    groups = [(g, x) for g, own in (("trusted", referee.TRUSTED), ("gap", referee.GAP)) for x in own]
    faults = lambda rows: {tuple(r) for r in referee.partition_faults(spark.createDataFrame(rows, "group string, label string"), labels).collect()}
    assert faults(groups) == set()
    assert faults([*groups[1:], ("gap", "ACL"), ("gap", "MCL"), ("gap", "Nose")]) == {("MCL", 2, True), ("Nose", 1, False)}
    assert faults(groups[1:]) == {(groups[0][1], 0, True)}


def test_gold_without_pseudo_labels_and_single_classes(spark):
    gold = spark.createDataFrame([(i, "A", i % 2) for i in range(6)] + [(i, "B", 1) for i in range(3)] + [(9, "A", None)], "id long, label string, y int")
    pseudo = spark.createDataFrame([(i, "A", 0.1 + 0.8 * (i % 2)) for i in range(4)] + [(i, "B", 0.4 + i / 10) for i in range(3)] + [(9, "A", 0.5), (77, "A", 0.5)], "id long, label string, p double")
    got = {r.label: r for r in metrics.evaluated(gold, pseudo).collect()}
    assert (got["A"].n, got["A"].accuracy, got["A"].auc) == (4, 1.0, 1.0)
    assert got["B"].n == 3 and got["B"].accuracy == pytest.approx(2 / 3) and got["B"].auc is None
    assert got["B"].macro_auc == 1.0


def test_leaks_skip_studies_without_fold(spark):
    train = spark.createDataFrame([("s1", "p"), ("s2", "p"), ("s3", "q"), ("s4", "q"), ("s5", ""), ("s6", None)], "study string, patient string")
    folds = spark.createDataFrame([("s1", 0), ("s2", 1), ("s3", 0), ("s5", 0), ("s6", 1)], "study string, fold int")
    assert [tuple(r) for r in splits.group_leaks(folds, train).collect()] == [("p", 2)]


def test_pooling_of_many_and_of_single_windows(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", "ACL", float(p)) for p in rng.random(500)] + [("one", "ACL", 0.3), ("two", "ACL", 0.7), ("two", "ACL", 0.7), (None, "ACL", 0.2), (None, "ACL", 0.4), (None, "ACL", 0.6)]
    got = {r.id: r.p for r in W.pool(spark.createDataFrame(rows, "id string, label string, p double").repartition(7), W.pooling_table(spark)).collect()}
    for i in {r[0] for r in rows}:
        p = np.array([r[2] for r in rows if r[0] == i])
        e = np.exp(6 * p)
        assert got[i] == pytest.approx(0.8 * np.sort(p)[-2:].mean() + 0.2 * (e * p).sum() / e.sum())
    assert W.pool(spark.createDataFrame([], "id string, label string, p double"), W.pooling_table(spark)).count() == 0


def test_central_rows(spark):
    rows = [("long", i) for i in range(20)] + [("three", i) for i in range(3)] + [("two", i) for i in range(2)] + [("one", 5), (None, 1), (None, 2), (None, 3)]
    got = W.central_rows(spark.createDataFrame(rows, "k string, i int"), "k", ["i"]).collect()
    held = {k: [(r.i, r["at"]) for r in sorted(got, key=lambda r: r.i) if r.k == k] for k in {r[0] for r in rows}}
    assert held["long"] == [(i, i - 3) for i in range(3, 17)]
    assert held["three"] == [(0, 0), (1, 1), (2, 2)] and held["two"] == [(0, 0), (1, 1)] and held["one"] == [(5, 0)]
    assert held[None] == [(1, 0), (2, 1), (3, 2)]
