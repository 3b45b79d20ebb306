"""The image source, the study worker and exact quantiles against numpy."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import studies, volumes
from tallyframe.operators.quantiles import quantiles
from tallyframe.sources import dicom, images


def save(root, study, series, name, data):
    folder = os.path.join(root, study, series)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("images"))
    rng = np.random.default_rng(1)
    for s in range(3):
        for k in range(2):
            for i in range(4 + s):
                values = rng.integers(0, 1000, (12, 10)).astype(np.uint16)
                fields = {"pos": f"0\\0\\{(7 * i) % 5}", "orient": "1\\0\\0\\0\\1\\0", "spacing": "0.5\\0.5", "image_side": "R" if k else ""}
                if i == 1:
                    fields |= {"slope": "2", "intercept": "-10"}
                if i == 2:
                    fields = {"pos": "a\\b"}  # malformed: defaults
                save(root, f"study{s}", f"series{s}{k}", f"{i:03d}.dcm", dicom.write(12, 10, values, **fields))
    save(root, "study0", "series00", "900.dcm", b"not an image")
    save(root, "study0", "series00", "901.dcm", dicom.write(12, 10, values)[:-20])
    save(root, "study0", "series00", "_hidden", b"x")
    return root


def test_source_reads_geometry_and_pixels(spark, folder):
    rows = images.image_series(spark, folder, ["study", "series", "no", "path", "rows", "cols", "pos", "orient", "spacing", "side", "slope", "intercept", "pixels", "error"]).collect()
    assert len(rows) == 2 * (4 + 5 + 6) + 2
    bad = [r for r in rows if r.error]
    assert {os.path.basename(r.path) for r in bad} == {"900.dcm", "901.dcm"} and all(r.pixels is None for r in bad)
    for r in rows:
        if r.error:
            continue
        told = dicom.read(open(r.path, "rb"), True)
        assert np.array_equal(np.frombuffer(r.pixels, np.float32), told["pixels"]) and (r.rows, r.cols) == (12, 10)
        i = int(os.path.basename(r.path)[:3])
        assert r.no == i and (r.slope, r.intercept) == ((2.0, -10.0) if i == 1 else (1.0, 0.0))
        assert r.pos == ([0.0, 0.0, 0.0] if i == 2 else [0.0, 0.0, float((7 * i) % 5)])
        assert r.spacing == ([1.0, 1.0] if i == 2 else [0.5, 0.5])
    fine, faults = images.readable(images.image_series(spark, folder, ["study", "series", "path", "error"]))
    # without pixels, a file whose pixels are cut off is readable
    assert fine.count() == len(rows) - 1 and [os.path.basename(r.path) for r in faults.collect()] == ["900.dcm"]


def test_metadata_reads_no_pixels():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    data = dicom.write(512, 512, np.ones((512, 512), np.int16), pos="1\\2\\3")
    told = dicom.read(Counted(data), False)
    assert told["pos"] == [1.0, 2.0, 3.0] and "pixels" not in told and Counted.taken <= len(data) - 512 * 512 * 2 + dicom.BLOCK
    assert dicom.read(io.BytesIO(data), True)["pixels"].sum() == 512 * 512
    with pytest.raises(ValueError):
        dicom.read(io.BytesIO(data[:220]), False)
    with pytest.raises(ValueError, match="transfer syntax"):
        dicom.read(io.BytesIO(data.replace(dicom.EXPLICIT.encode() + b"\0", b"1.2.840.10008.1.2.4.", 1)), False)


def test_source_pushes_series_and_plans_by_size(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = images.image_series(spark, folder, ["study", "series", "path"]).where("series = 'series10'")
        assert df.count() == 5
        assert images.image_series(spark, folder, ["study", "series"]).where("study in ('study2', 'gone') and series <> 'series20'").count() == 6
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert images.image_series(spark, folder, ["series"], series="series10,series21").count() == 11
    reader = images.PushingReader({"path": folder, "partitionbytes": "1500"}, None, dicom.read)
    parts = reader.partitions()
    assert len(parts) > 6 and sum(stop - start for p in parts for *_, start, stop in p.folders) == 32
    reader.pushFilters([])
    asked = list(reader.pushFilters([images.EqualTo(("series",), "series10"), images.EqualTo(("rows",), 3)]))
    assert [f.attribute for f in asked] == [("rows",)] and {f[1] for p in reader.partitions() for f in p.folders} == {"series10"}
    assert len(images.SeriesReader({"path": folder}, None, dicom.read).partitions()) == 1


def test_source_with_own_decoder(spark, folder):
    def decode(file, pixels):
        return {"rows": len(file.read()), "side": "x"}

    rows = images.image_series(spark, folder, ["path", "rows", "side", "error"], decode).collect()
    assert all(r.error is None and r.rows == os.path.getsize(r.path) and r.side == "x" for r in rows) and len(rows) == 32


# quantiles


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles(spark, monkeypatch, few):
    from tallyframe.operators import quantiles as Q

    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", 4096 if few > 3 else 16)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.standard_normal(3000),
        "heavy": rng.standard_cauchy(2000) ** 5,
        "ties": np.repeat([0.0, 1.0, 5.0], [500, 1, 400]),
        "tiny": rng.standard_normal(500) * 1e-300,
        "one": np.array([7.25]),
        None: np.array([1.7e308, -1.7e308, 0.0, -0.0, 5e-324]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", float("nan")), ("normal", None), ("normal", float("inf")), ("void", None)]
    df = spark.createDataFrame(rows, "k string, x double").withColumns({"v": F.lit("clash"), "n": F.lit(0)}).repartition(5)
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r.k: (r.n, r.qs) for r in quantiles(df, ["k"], "x", probs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = np.sort(vs)
        want = []
        for p in probs:
            at = (len(s) - 1) * p
            a, b = float(s[int(np.floor(at))]), float(s[int(np.ceil(at))])
            want.append(a + (b - a) * (at - np.floor(at)))
        assert got[k][0] == len(vs)
        assert got[k][1] == pytest.approx(want, rel=1e-12, abs=0) or k is None
    assert quantiles(df.where("1 = 0"), ["k"], "x", probs).count() == 0


def test_bounds_of_flat_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 500 + [("a", 9.0), ("b", 2.0)], "k string, v double")
    got = {r.k: (r.lo, r.hi) for r in volumes.intensity_bounds(df, ["k"]).collect()}
    assert got == {"a": (1.0, 9.0), "b": (2.0, 2.0)}
    flat = spark.createDataFrame([([1.0] * 300 + [5.0],)], "v array<double>").select(volumes.normalised_array(F.col("v")).alias("n")).first().n
    assert flat == [0.0] * 300 + [1.0]


# the study worker


def brute_volume(slices, plane, size, crop):
    """The stack of a series as numpy does it in one piece."""
    slices = sorted(slices, key=lambda s: s["no"])
    o = np.asarray(slices[0]["orient"], float)
    normal = np.cross(o[:3], o[3:])
    normal = normal / np.linalg.norm(normal)
    order = np.argsort([float(np.dot(s["pos"], normal)) for s in slices], kind="stable")
    planes = []
    for i in order:
        s = slices[i]
        n = [max(1, min(m, round(crop / p))) for m, p in zip((s["rows"], s["cols"]), s["spacing"], strict=True)]
        a = [(m - k) // 2 for m, k in zip((s["rows"], s["cols"]), n, strict=True)]
        image = np.asarray(s["pixels"], np.float32).reshape(s["rows"], s["cols"])[a[0] : a[0] + n[0], a[1] : a[1] + n[1]]
        planes.append(volumes.resize(image, size, size).astype(np.float32))
    v = np.stack(planes)
    known = np.sort(v[np.isfinite(v)].astype(np.float64))

    def at(q):
        p = (len(known) - 1) * q
        return known[int(np.floor(p))] + (known[int(np.ceil(p))] - known[int(np.floor(p))]) * (p - np.floor(p))

    lo, hi = at(0.01), at(0.99)
    if not hi > lo:
        lo, hi = known[0], known[-1]
    v = np.zeros_like(v) if not hi > lo else ((np.clip(np.nan_to_num(v, nan=lo), lo, hi).astype(np.float32) - np.float32(lo)) / np.float32(hi - lo)).astype(np.float32)
    tag = next((slices[i]["side"] for i in order if slices[i]["side"]), None)
    side = tag.strip().upper()[0] if tag and tag.strip().upper()[:1] in ("L", "R") else "L" if np.mean([s["pos"][0] for s in slices]) >= 0 else "R"
    if side == "R":
        v = v[::-1] if plane.strip().lower() == "sagittal" else v[:, :, ::-1]
    return v


def brute_cache(v, size):
    top = v.max(0) > 8 / 255
    r, c = np.nonzero(top)
    if len(r) >= 100:
        v = v[:, max(0, r.min() - 4) : r.max() + 5, max(0, c.min() - 4) : c.max() + 5]
    v = np.stack([volumes.resize(x, size, size).astype(np.float32) for x in v])
    lo = int(len(v) * 0.15)
    v = v[lo : max(int(len(v) * 0.85), lo + 3)]
    return np.clip(v * np.float32(255), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    rows, planes = [], {}
    kinds = [("sagittal", "R", 9), ("coronal", "R", 7), (" Axial", None, 12), ("Sagittal", "left", 1), ("coronal", None, 2), ("axial", "R", 40)]
    for k, (plane, side, n) in enumerate(kinds):
        series = f"s{k}"
        planes[series] = plane
        for i in range(n):
            shape = (30 + k, 26)
            image = np.zeros(shape, np.float32)
            image[8:22, 6 + k : 20 + k] = rng.random((14, 14)) * 900 + 10 * i
            if k == 2:
                image[0, 0], image[1, 1] = np.nan, np.inf
            tilt = [1.0, 0.0, 0.0, 0.0, 0.8, 0.6]
            pos = [(-3.0 if k in (2, 4) else 2.0) + i % 2, float((i * 5) % 7), float((i * 3) % n) * 2]
            rows.append((f"p{k % 3}", series, i, shape[0], shape[1], pos, tilt, [0.5, 0.7], side if i else "", image.ravel().tobytes()))
    rows.append(("p0", "broken", 0, 4, 4, [0.0] * 3, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0.0, 1.0], "R", np.zeros(16, np.float32).tobytes()))
    rows.append(("p0", "flat", 0, 4, 4, [0.0] * 3, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [1.0, 1.0], "R", np.zeros(16, np.float32).tobytes()))
    rows.append(("p1", "dark", 0, 4, 4, [0.0] * 3, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 1.0], "R", np.zeros(16, np.float32).tobytes()))
    planes |= {"broken": "axial", "flat": "axial", "dark": "axial"}
    schema = "study string, series string, no int, rows int, cols int, pos array<double>, orient array<double>, spacing array<double>, side string, pixels binary"
    df = spark.createDataFrame(rows, schema).withColumns({"n": F.lit("clash"), "place": F.lit(1), "flip": F.lit("x")}).repartition(7)
    each = {}
    for r in rows:
        each.setdefault((r[0], r[1]), []).append(dict(zip("study series no rows cols pos orient spacing side".split(), r, strict=False)) | {"pixels": np.frombuffer(r[9], np.float32)})
    tables = spark.createDataFrame([(s, x, planes[x]) for s, x in each], "study string, series string, plane string")
    return df, tables, each, planes


def test_volume_slices(spark, made):
    df, planes, each, plane_of = made
    slices, faults = studies.volume_slices(df, planes, crop_mm=12.0, size=16)
    got = {}
    for r in slices.collect():
        got.setdefault((r.study, r.series), {})[r.place] = np.frombuffer(r["data"], np.float32).reshape(16, 16)
    assert {(r.study, r.series): r.fault for r in faults.collect()} == {("p0", "broken"): "a slice has no valid size or spacing", ("p0", "flat"): "degenerate orientation"}
    assert set(got) == set(each) - {("p0", "broken"), ("p0", "flat")}
    for key, places in got.items():
        want = brute_volume(each[key], plane_of[key[1]], 16, 12.0)
        assert sorted(places) == list(range(len(want)))
        assert np.array_equal(np.stack([places[i] for i in range(len(want))]), want)


def test_study_cache(spark, made):
    df, planes, each, plane_of = made
    slots = [(s, f"slot-{x}", x) for s, x in each if x != "s1"] + [("p0", "again", "s0"), ("p2", "gone", "nowhere")]
    cache, faults = studies.study_cache(df, planes, spark.createDataFrame(slots, "study string, slot string, series string"), 14.0, 24, 10)
    got = {}
    for r in cache.collect():
        got.setdefault((r.study, r.slot), {})[r.place] = (r.n, np.frombuffer(r["data"], np.uint8).reshape(10, 10))
    assert {r.slot for r in faults.collect()} == {"slot-broken", "slot-flat"}
    assert {slot for _, slot in got} == {x for _, x, s in slots if s not in ("broken", "flat", "nowhere")}
    for study, slot, series in slots:
        if (study, slot) in got:
            want = brute_cache(brute_volume(each[study, series], plane_of[series], 24, 14.0), 10)
            own = got[study, slot]
            assert sorted(own) == list(range(len(want))) and {n for n, _ in own.values()} == {len(want)}
            assert np.array_equal(np.stack([own[i][1] for i in range(len(want))]), want), slot
    whole = {(r.study, r.slot): r for r in studies.stacks(cache).collect()}
    assert whole["p0", "again"]["data"] == b"".join(got["p0", "again"][i][1].tobytes() for i in sorted(got["p0", "again"])) and whole["p0", "again"].n == len(got["p0", "again"])
    none, no_faults = studies.study_cache(df.where("1 = 0"), planes, spark.createDataFrame(slots, "study string, slot string, series string"), 14.0, 24, 10)
    assert none.count() == 0 and no_faults.count() == 0


def test_cache_of_a_folder(spark, folder, tmp_path):
    files = images.image_series(spark, folder, ["study", "series", "no", "path", "rows", "cols", "pos", "orient", "spacing", "side", "pixels", "error"])
    fine, _ = images.readable(files)
    planes = fine.select("study", "series").distinct().withColumn("plane", F.lit("coronal"))
    slots = planes.select("study", F.lit("A").alias("slot"), "series").where("series like '%0'")
    cache, faults = studies.study_cache(fine, planes, slots, 100.0, 12, 8)
    studies.write_cache(cache, f"{tmp_path}/cache")
    back = spark.read.parquet(f"{tmp_path}/cache")
    assert back.groupBy("study", "slot").count().count() == 3 and faults.count() == 0
    assert {len(r["data"]) for r in back.select("data").collect()} == {64}


def test_sortable_floats():
    x = np.array([-np.inf, -1e30, -1.5, -1e-40, -0.0, 0.0, 1e-40, 2.0, 3e38, np.inf], np.float32)
    u = studies.sortable(x)
    assert (np.diff(u.astype(np.int64)) > 0).all() and np.array_equal(studies.unsortable(u), x)
