"""Operators on small literal tables with results worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import geometry as G
from tallyframe.functions import values as V
from tallyframe.operators import corrections as C
from tallyframe.operators import metrics as M
from tallyframe.operators import ranks as R
from tallyframe.operators import referee, splits, volumes
from tallyframe.operators import slots as S
from tallyframe.operators import tables as J
from tallyframe.operators import windows as W
from tallyframe.sources import readers, writers


def brute_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a == 1], [b for a, b in zip(y, p) if a != 1]
    return sum((x > z) + (x == z) / 2 for x in pos for z in neg) / (len(pos) * len(neg))


def test_auc(spark):
    random.seed(3)
    rows = [("A", random.randint(0, 1), random.randint(0, 6) / 6) for _ in range(60)] + [("one", 1, 0.5), ("perfect", 0, 0.1), ("perfect", 1, 0.8)]
    got = {r.label: r.auc for r in M.auc_by(spark.createDataFrame(rows, "label string, y int, p double"), ["label"]).collect()}
    assert got["A"] == pytest.approx(brute_auc([r[1] for r in rows[:60]], [r[2] for r in rows[:60]]))
    assert got["one"] is None and got["perfect"] == 1.0


def test_rank_blend(spark):
    rows = [("a", "x", "L", 0.1), ("a", "y", "L", 0.9), ("b", "x", "L", 0.9), ("b", "y", "L", 0.1)]
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "member string, w double")
    got = {r.id: r.score for r in R.rank_average(spark.createDataFrame(rows, "member string, id string, label string, p double"), w).collect()}
    assert got == {"x": 0.625, "y": 0.875}


def test_tied_ranks(spark):
    df = spark.createDataFrame([("k", 0.1), ("k", 0.1), ("k", 0.2), ("k", 0.9), ("one", 0.4)], "k string, p double")
    got = sorted((r.k, r.p, r.a, r.f) for r in R.with_ranks(df, ["k"], "p").select("k", "p", F.col("avg_rank").alias("a"), R.fold_rank("p").alias("f")).collect())
    assert [g[2] for g in got] == [1.5, 1.5, 3.0, 4.0, 1.0] and got[-1][3] == 0.4


def test_slots(spark):
    rows = [("s1", "b", " Sagittal ", 1, 1, 30), ("s1", "a", "SAGITTAL", 1, 1, 30), ("s1", "c", "coronal", 0, 1, 9), ("s2", "d", "axial", 0, 0, 5)]
    series = spark.createDataFrame(rows, "study string, series string, plane string, fluid int, fat int, n int")
    got = {r.study: r.asDict() for r in S.slot_table(series, S.rule_table(spark)).collect()}
    assert got["s1"]["SAG_FLUID_FS"] == "a" and got["s1"]["COR_T1"] == "c" and got["s1"]["AX_FLUID_FS"] is None
    assert set(got["s2"].values()) == {"s2", None}
    best = {(r.study, r.slot): r.series for r in S.select_slots(series, S.rule_table(spark)).collect()}
    assert best == {("s1", "SAG_FLUID_FS"): "a", ("s1", "COR_T1"): "c"}


@pytest.mark.parametrize("n,starts,first", [(100, list(range(20, 78)), [20, 21, 22]), (3, [0], [0, 1, 2]), (2, [0], [0, 1, 1]), (1, [0], [0, 0, 0])])
def test_windows(spark, n, starts, first):
    df = spark.range(1).select(F.lit(n).alias("n"))
    row = df.select(W.window_starts(F.col("n")).alias("s"), W.window_indices(F.col("n"), W.window_starts(F.col("n"))[0]).alias("i")).first()
    assert row.s == starts and row.i == first


def test_spread_rounds_half_to_even(spark):
    row = spark.range(1).select(W.spread(F.array(*[F.lit(i) for i in range(6)]), F.lit(3)).alias("s")).first()
    assert row.s == [0, 2, 5]


def test_pooling(spark):
    rows = [("x", lab, p) for lab in ("Fracture", "ACL", "Effusion") for p in (0.1, 0.5, 0.9)]
    got = {r.label: r.p for r in W.pool(spark.createDataFrame(rows, "id string, label string, p double"), W.pooling_table(spark)).collect()}

    def soft(b):
        e = np.exp(b * np.array([0.1, 0.5, 0.9]))
        return float((e / e.sum() * [0.1, 0.5, 0.9]).sum())

    assert got["Fracture"] == pytest.approx(0.8 * 0.9 + 0.2 * soft(10))
    assert got["ACL"] == pytest.approx(0.8 * 0.7 + 0.2 * soft(6))
    assert got["Effusion"] == pytest.approx(0.5)


def test_values(spark):
    row = spark.range(1).select(
        V.unit(F.lit("x")).alias("a"), V.unit(F.lit("NaN")).alias("b"), V.unit(F.lit(3.0)).alias("c"), V.binarise(F.lit(None).cast("double")).alias("d"),
        V.confidence_weight([F.lit(0.5), F.lit(None).cast("double")]).alias("e"), V.confidence_weight([F.lit(1.0), F.lit(0.0)]).alias("f"), V.confidence_weight([F.lit(None).cast("double")]).alias("g"),
    ).first()
    assert tuple(row) == (0.5, 0.5, 1.0, 0, 0.25, 1.0, 0.25)


def test_folds_do_not_leak(spark):
    rows = [("s1", "p1", "A", "en"), ("s2", "p1", "A", "en"), ("s3", "p2", "B", "fr"), ("s4", "", "B", "fr")]
    folds = splits.cv_splits(spark.createDataFrame(rows, "study string, patient string, site string, language string"), 3, 7)
    got = {r.study: r.fold for r in folds.collect()}
    assert got["s1"] == got["s2"] and set(got.values()) <= {0, 1, 2}
    assert splits.leaks(folds.where("patient <> ''"), "patient").count() == 0
    with pytest.raises(ValueError):
        splits.cv_splits(folds, 1)


def test_stratified_split(spark):
    rows = [(f"g{i}", *[float((i + k) % (k + 2) == 0) for k in range(4)]) for i in range(58)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double, d double")
    one = {r.id: r.slice for r in splits.stratified_split(df, list("abcd"), 18).collect()}
    two = {r.id: r.slice for r in splits.stratified_split(df.orderBy(F.desc("id")), list("abcd"), 18).collect()}
    assert one == two and sum(s == "locked" for s in one.values()) == 18
    for k in range(4):
        held = sum(r[k + 1] for r in rows if one[r[0]] == "locked")
        assert abs(held - sum(r[k + 1] for r in rows) * 18 / 58) <= 1.5


def test_sorted_index(spark):
    df = spark.range(100).select((F.col("id") * 7 % 50).alias("k"))
    got = {r.k: r.i for r in splits.sorted_index(df, "k", "i").collect()}
    assert got == {k: k for k in range(50)}


def test_geometry(spark):
    o = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])
    flat = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 2, 0, 0)])
    box = lambda r, c, a, b, mm=130.0: G.crop_bounds(F.lit(r), F.lit(c), F.lit(a), F.lit(b), mm)
    row = spark.range(1).select(
        G.slice_normal(o).alias("n"), G.slice_normal(flat).alias("none"), G.order_by_position(F.array(F.lit(2.0), F.lit(1.0), F.lit(2.0))).alias("i"),
        box(512, 512, 0.5, 0.5).alias("b1"), box(20, 20, 4.0, 4.0).alias("b2"), box(100, 100, 2.0, 2.0).alias("b3"), box(0, 10, 1.0, 1.0).alias("b4"),
        G.laterality(F.lit(" right"), F.lit(5.0)).alias("l1"), G.laterality(F.lit(None).cast("string"), F.lit(-1.0)).alias("l2"), G.laterality(F.lit(None).cast("string"), F.lit(None).cast("double")).alias("l3"),
    ).first()
    assert row.n == [0.0, 0.0, 1.0] and row.none is None and row.i == [1, 0, 2]
    assert tuple(row.b1) == (126, 386, 126, 386) and tuple(row.b2) == (0, 20, 0, 20) and tuple(row.b3) == (17, 82, 17, 82) and row.b4 is None
    assert (row.l1, row.l2, row.l3) == ("R", "R", "L")


def test_normalised_array(spark):
    vals = [1.0, 2.0, float("nan"), 3.0, 100.0]
    df = spark.createDataFrame([(vals,), ([5.0, 5.0],)], "v array<double>")
    a, b = (r.n for r in df.select(volumes.normalised_array(F.col("v")).alias("n")).collect())
    lo, hi = np.percentile([1, 2, 3, 100], [1, 99])
    assert a == pytest.approx([(min(hi, max(lo, v)) - lo) / (hi - lo) if v == v else 0.0 for v in vals]) and b == [0.0, 0.0]


def test_ordered_slices(spark):
    rows = [("x", no, [0.0, 0.0, float(z)], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for no, z in enumerate((3, 1, 2))]
    df = spark.createDataFrame(rows, "series string, no int, pos array<double>, orient array<double>")
    assert volumes.ordered_slices(df).first().idx == [1, 2, 0]


def test_side_normalised(spark):
    rows = [("R", " Sagittal"), ("R", "axial"), ("L", "sagittal"), (None, "axial"), ("r", "coronal")]
    df = spark.createDataFrame(rows, "side string, plane string")
    stack = F.array(F.array(F.array(F.lit(1), F.lit(2))), F.array(F.array(F.lit(3), F.lit(4))))
    got = [r.s for r in df.coalesce(1).select(volumes.side_normalised(stack, F.col("plane"), F.col("side")).alias("s")).collect()]
    same, mirrored = [[[1, 2]], [[3, 4]]], [[[2, 1]], [[4, 3]]]
    assert got == [[[[3, 4]], [[1, 2]]][:2], mirrored, same, same, mirrored]


def test_tables(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    one = spark.createDataFrame([("a", "0.5")], "id string, ACL string")
    with pytest.raises(Exception, match="no prediction"):
        writers.submission(ids, one, ["ACL"]).collect()
    assert writers.submission(ids.where("id = 'a'"), one, ["ACL"]).first().ACL == "0.5"
    with pytest.raises(Exception, match="locked id"):
        J.locked_guard(ids, one, "id").collect()
    assert J.locked_guard(ids, one, "id", unlock=True).count() == 2
    with pytest.raises(ValueError, match="missing"):
        J.require(ids, ["x"])


def test_json_results(spark):
    files = [(0, '{"u1": {"language": "en", "labels": {"ACL": {"status": "affirmed", "evidence": "x"}}}}'), (1, '{"u1": {"language": "en", "labels": {"ACL": {"status": "negated", "evidence": "y"}}}, "u2": {"language": "en", "labels": {"ACL": {"status": "maybe", "evidence": ""}}}}')]
    got = {r.id: (r.status, r.error) for r in readers.json_results(spark.createDataFrame(files, "file_ord int, value string"), "agent").collect()}
    assert got["u1"] == ("negated", "") and got["u2"] == (None, "bad status for ACL")


def test_cache_versions(spark):
    v = '{"model": "m", "prompt_version": %d, "response": {"language": "en", "labels": {}}, "error": null}'
    cache = spark.createDataFrame([("a", v % 2), ("b", v % 1), ("c", "{broken")], "id string, value string")
    ok = readers.cached_results(cache, "m", 2)
    assert [r.id for r in ok.collect()] == ["a"]
    assert sorted(r.id for r in readers.uncached(cache.select("id"), ok).collect()) == ["b", "c"]


def test_files(spark, tmp_path):
    row = writers.run_row(spark, run_id="r1", macro_auc=0.5, train_minutes=1.5, cost_usd=None, per_label_auc={"ACL": 0.5})
    writers.append(row, str(tmp_path / "log"))
    writers.append(row, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 and back.first().macro_auc == "0.50000000" and back.first().per_label_auc == '{"ACL":0.5}'
    split = spark.createDataFrame([("a", "locked"), ("b", "working")], "id string, slice string")
    positives = spark.createDataFrame([("a", "ACL", 1)], "id string, label string, y int")
    writers.write_once(writers.split_payload(split, positives, 2026).coalesce(1), str(tmp_path / "split"))
    assert {(r.id, r.slice) for r in readers.split_json(spark, str(tmp_path / "split")).collect()} == {("a", "locked"), ("b", "working")}
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_once(split, str(tmp_path / "split"))
    assert not writers.write_if_any(split.where("id = 'z'"), str(tmp_path / "none"))
    writers.write_csv(spark.createDataFrame([("1.2.840", 'a "q"\nline', 1.0)], "uid string, text string, ACL double"), str(tmp_path / "csv"))
    st = readers.studies(spark, str(tmp_path / "csv"), ["ACL"], "uid", "text").first()
    assert (st.id, st.report, st.ACL) == ("1.2.840", 'a "q"\nline', 1.0)


def corr_rows(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = [(i, lab, float(rng.random() < 0.3), rng.random()) for i in range(n) for lab in ("A", "B")]
    return C.prepared(spark.createDataFrame(rows, "id long, label string, cur double, p double"))


def brute_cap(rows, low, high, most=None):
    s, out = sum(r["given"] for r in rows), set()
    for r in sorted((r for r in rows if r["flag"]), key=lambda r: (-abs(r["p"] - 0.5), r["id"])):
        if most is not None and len(out) >= most:
            break
        x = s + (1 if r["given"] == 0 else -1)
        if low <= x <= high:
            s, _ = x, out.add(r["id"])
    return out


@pytest.mark.parametrize("most", [None, 5, 0])
def test_cap_is_the_walk(spark, most):
    rows = corr_rows(spark).withColumn("flag", F.pmod(F.xxhash64("id", "label"), F.lit(3)) > 0)
    w = spark.createDataFrame([("A", 0.8), ("B", 0.66)], "label string, w double")
    limits = C.bands(rows, w)
    got = {(r.label, r.id) for r in C.capped(rows, limits, most).where("accepted").collect()}
    held, lim = rows.collect(), {r.label: r for r in limits.collect()}
    want = {(x, i) for x in "AB" for i in brute_cap([r.asDict() for r in held if r.label == x], lim[x].low, lim[x].high, most)}
    assert got == want


def test_cap_is_the_walk_over_many_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        test_cap_is_the_walk(spark, None)
    finally:
        spark.conf.unset(key)


def test_round_keeps_gold_and_bands(spark):
    rows = corr_rows(spark, 300, 5)
    gold = spark.createDataFrame([(i,) for i in range(50)], "id long")
    w = spark.createDataFrame([("A", 0.9), ("B", 0.7)], "label string, w double")
    pairs = C.pair_table(spark, (("A", "B"),))
    out = C.run_corrections(rows.select("id", "label", "cur", "p"), w, gold, pairs)
    assert out["labels"].where("id < 50 and accepted").count() == 0
    for r in out["counts"].collect():
        assert abs(r.prevalence_after - r.prevalence_before) <= 0.2 * r.prevalence_before + 1e-9
    assert all(r.within for r in out["joint"].collect())
    same = C.run_corrections(rows.select("id", "label", "cur", "p"), w, gold, pairs, identity=True)
    assert same["labels"].where("new <> cur").count() == 0
    assert "counts" in writers.corrections_report(out).first().report
    assert writers.summary(out["counts"]).count() == 2


def test_codrift(spark):
    def rows(a, b):
        return spark.createDataFrame([(i, x, 0.0, 0.5, 0, i in hit) for i in range(100) for x, hit in (("A", a), ("B", b))], "id long, label string, cur double, p double, given int, accepted boolean")

    pairs = C.pair_table(spark, (("A", "B"),))
    assert C.codrift(rows(range(12), range(12)), pairs).first().flagged
    assert not C.codrift(rows(range(8), range(8, 16)), pairs).first().flagged


def oof_rows(spark, noise_prev, noise_new, n=200):
    rng = random.Random(7)
    rows = [(i, x, int(i % 3 == 0), int(i % 3 == 0), (i % 3 == 0) + rng.gauss(0, noise_prev), (i % 3 == 0) + rng.gauss(0, noise_new)) for i in range(n) for x in ("ACL", "Effusion")]
    return spark.createDataFrame(rows, "id long, label string, y int, y_new int, prev double, new double")


def test_gate_and_stop(spark):
    good = referee.cv_gate(referee.auc_deltas(oof_rows(spark, 0.9, 0.35)))
    bad = referee.cv_gate(referee.auc_deltas(oof_rows(spark, 0.35, 0.9)))
    assert good.first().accepted and not bad.first().accepted and bad.first().degraded == ["ACL"] and set(good.first().advisory) == {"Effusion"}
    assert tuple(referee.stop_decision(good, None, 1).first())[:2] == (False, False)
    assert tuple(referee.stop_decision(good, None, 3).first())[:2] == (True, False)
    assert tuple(referee.stop_decision(bad, None, 1).first())[:2] == (True, True)
    with pytest.raises(Exception, match="no trusted label"):
        referee.cv_gate(referee.auc_deltas(oof_rows(spark, 0.9, 0.35).where("label = 'Effusion'"))).collect()


def test_gold_and_final_checks(spark):
    worse = oof_rows(spark, 0.3, 2.5, 60).select("id", "label", "y", "prev", "new")
    r = referee.gold_check(worse, 2, draws=40).first()
    assert r.ran and r.veto and r.macro_delta < 0 and r.agreement > 0.9
    assert referee.gold_check(worse, 1).first().signal == "skipped"
    with pytest.raises(PermissionError):
        referee.final_check(worse)
    assert referee.final_check(worse, unlock=True, draws=10).first().veto


def test_loss(spark):
    df = spark.createDataFrame([(2.0, 1.0, 1.0), (-3.0, 1.0, 0.0), (1e3, 0.0, 0.5)], "x double, y double, w double")
    got = df.agg(M.weighted_loss(F.col("x"), F.col("y"), F.col("w")).alias("l")).first().l
    assert got == pytest.approx((math.log1p(math.exp(-2.0)) + 0.5 * 1e3) / 1.5)


def test_streamed_results(spark, tmp_path):
    from tallyframe.streaming import results

    rows = spark.createDataFrame([("a", "ACL", "affirmed", 0.9), ("a", "ACL", "negated", 0.1), ("b", "ACL", "negated", 0.05)], "id string, label string, status string, score double").withColumn("created", F.current_timestamp())
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        results.take_up(results.incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("small", [True, False])
def test_ranks_with_hot_values(spark, monkeypatch, small):
    """A value that most rows have, null keys and values, by windows and by ranges."""
    if not small:
        monkeypatch.setattr(R, "ONE_TASK", 0)
        monkeypatch.setattr(R, "MOST_BROADCAST", 0)
        monkeypatch.setattr(R, "HOT_ROWS", 50)
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), 0.5 if rng.random() < 0.6 else rng.choice([None, round(rng.random(), 2)])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, p double").repartition(6)
    got = {r.id: (r.avg_rank, r.n) for r in R.with_ranks(df, ["k"], "p").collect()}
    assert len(got) == 900
    for i, k, p in rows:
        own = [-1.0 if q is None else q for _, x, q in rows if x == k]
        v = -1.0 if p is None else p
        assert got[i] == (sum(q < v for q in own) + (sum(q == v for q in own) + 1) / 2, len(own))
    scores = df.withColumn("y", (F.pmod("id", F.lit(3)) == 0).cast("int"))
    aucs = {r.k: r.auc for r in M.auc_by(scores, ["k"]).collect()}
    for k in ("a", "b", None):
        pos, neg = ([-1.0 if p is None else p for i, x, p in rows if x == k and (i % 3 == 0) == s] for s in (True, False))
        assert aucs[k] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_central_rows_of_a_hot_key(spark, monkeypatch):
    from tallyframe.operators import windows as W

    monkeypatch.setattr(R, "MOST_BROADCAST", 0)
    monkeypatch.setattr(R, "HOT_ROWS", 100)
    rows = [("hot", i) for i in range(1000)] + [(f"k{i}", j) for i in range(30) for j in range(i)] + [(None, j) for j in range(5)]
    got = W.central_rows(spark.createDataFrame(rows, "k string, i int").repartition(5), "k", ["i"]).collect()
    held = {}
    for r in got:
        held.setdefault(r.k, []).append((r.i, r["at"]))
    for k, n in [("hot", 1000), (None, 5), *[(f"k{i}", i) for i in range(1, 30)]]:
        a, b = (0, n) if n < 3 else (math.floor(n * 0.15), max(math.ceil(n * 0.85), math.floor(n * 0.15) + 1))
        assert sorted(held[k]) == [(i, i - a) for i in range(a, b)]


def test_seeded_start(spark):
    """The group of a seed starts in the central band, the same for a seed, and seeds spread over all starts."""
    from tallyframe.operators import windows as W

    df = spark.range(400).select(F.lit(20).alias("n"), F.col("id")).select(W.window_starts(F.col("n")).alias("s"), "id")
    got = [r.x for r in df.select(W.seeded_start(F.col("s"), F.concat_ws("|", F.lit("7"), F.col("id").cast("string"))).alias("x")).collect()]
    again = [r.x for r in df.select(W.seeded_start(F.col("s"), F.concat_ws("|", F.lit("7"), F.col("id").cast("string"))).alias("x")).collect()]
    assert got == again and set(got) == set(range(4, 14))
    short = spark.range(1).select(W.seeded_start(W.window_starts(F.lit(2)), F.lit("x")).alias("x")).first().x
    assert short == 0


def test_sections_keep_control_characters(spark):
    from tallyframe.functions import text as T

    texts = ["pre Findings: a\x01b Impression: c", "a\x01b", "\x01\x02findings\x01\x02: x\x01\x03", "Findings:\x02y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: [tuple(s) for s in r.s] for r in df.select("id", T.split_sections(F.col("t")).alias("s")).collect()}
    assert got[0] == [("other", "pre"), ("findings", "a\x01b"), ("impression", "c")]
    assert got[1] == [("findings", "a\x01b")]
    assert got[3] == [("findings", "\x02y")]
    assert "".join(t for _, t in got[2]).count("\x01") >= 2
