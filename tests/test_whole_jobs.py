"""Queries that once left rows out, held against brute force."""

import hashlib

import numpy as np
import pytest

from tallyframe.operators import referee
from tallyframe.plans import queries as Q


def test_bootstrap_of_all_customers(spark, tmp_path):
    rows = [(i, i % 5, "AB"[i % 3 == 0], float((i * 2711) % 9000)) for i in range(1, 41)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.label: r for r in Q.QUERIES["agg26_bootstrap_whole"](spark, str(tmp_path)).collect()}

    def auc(a, b):
        return ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))

    def change(pos, neg):
        return auc(pos[:, 1], neg[:, 1]) - auc(pos[:, 0], neg[:, 0])

    assert set(got) == {"A", "B"} and referee.DRAWS == 3000
    for label in got:
        own = {y: np.array([(b, (i * 7919) % 1000 + b / 10) for i, _, s, b in rows if s == label and (b > 4000) == y]) for y in (0, 1)}
        point = change(own[1], own[0])
        same = 0
        for draw in range(1, 3001):
            pick = {y: own[y][[int(hashlib.sha256(f"2026|{label}|{y}|{draw}|{k + 1}".encode()).hexdigest()[:8], 16) % len(own[y]) for k in range(len(own[y]))]] for y in own}
            d = change(pick[1], pick[0])
            same += abs(d) > 1e-12 and (d > 0) == (point > 0)
        assert got[label].point == pytest.approx(point, abs=1e-6) and got[label].agreement == pytest.approx(same / 3000, abs=1e-3)


def test_split_of_all_labels(spark, sf_dir):
    labels = {str(r.doc_id): (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    df = Q.QUERIES["itr01_stratified_split"](spark, sf_dir)
    got = {r.id: r.slice for r in df.collect()}
    assert set(got) == set(labels) and sum(s == "locked" for s in got.values()) == 12
    for k in range(2):
        assert abs(sum(v[k] for i, v in labels.items() if got[i] == "locked") - sum(v[k] for v in labels.values()) * 12 / len(labels)) <= 1
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan


def test_whole_orders_have_every_row(spark, sf_dir):
    orders = [(r.o_totalprice, r.o_orderkey) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()]
    got = {r.place: r.o_orderkey for r in Q.QUERIES["srt01_whole"](spark, sf_dir).collect()}
    assert [got[i] for i in range(len(orders))] == [k for _, k in sorted(orders, key=lambda o: (-o[0], o[1]))]
    keys = [r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()]
    got = {r.place: r.c_custkey for r in Q.QUERIES["srt08_whole"](spark, sf_dir).collect()}
    assert [got[i] for i in range(len(keys))] == sorted(keys, key=lambda k: hashlib.sha256(f"2026|{k}".encode()).hexdigest())
