"""From slices to a cache of studies: each series cropped, scaled, ordered, side-normalised, boxed and trimmed.

Slices go through one by one; what a series has in common (order, bounds of intensity, box) is aggregated beside them and
comes back as a row for each series. So a task holds some slices and never a stack, however many slices a series has.
Two passes read the resized frames: the first finds the bounds, the second makes the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crop_bounds, dot, laterality, slice_normal
from ..steps import forget, written
from .splits import placed
from .volumes import resize

#: Rows of series that are broadcast; beyond that Spark joins them by a shuffle.
MOST_BROADCAST = 2_000_000
#: Quantiles of intensity, the least value and number of places of a box and what is added around it, the
#: band of slices that stays and the least number of them, and the sizes of frames before and after the box.
QUANTILES = (0.01, 0.99)
BOX_LEVEL, BOX_LEAST, BOX_PAD = 8.0 / 255.0, 100, 4
BAND, BAND_LEAST = (0.15, 0.85), 3
FRAME, SIZE, CROP_MM = 336, 224, 130.0

KEYS = ["study", "series"]


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def sortable(x: np.ndarray) -> np.ndarray:
    """uint32 in the order of float32 numbers."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31))


def unsortable(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, np.uint32)
    return np.where(u >> 31 == 1, u & np.uint32((1 << 31) - 1), ~u).astype(np.uint32).view(np.float32)


def scaled_frame(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """float32 values clipped to lo..hi and scaled to 0..1; what isn't a number counts as lo, and an empty range gives 0."""
    if not hi > lo:
        return np.zeros_like(x, np.float32)
    clipped = np.clip(np.nan_to_num(x, nan=lo), lo, hi).astype(np.float32)
    return ((clipped - np.float32(lo)) / np.float32(hi - lo)).astype(np.float32)


def box_of(top: np.ndarray) -> tuple[int, int, int, int] | None:
    """(r0, r1, c0, c1) around the places of a scaled projection over BOX_LEVEL, padded; None if they are few."""
    r, c = np.nonzero(top > BOX_LEVEL)
    if len(r) < BOX_LEAST:
        return None
    return max(0, int(r.min()) - BOX_PAD), min(top.shape[0], int(r.max()) + BOX_PAD + 1), max(0, int(c.min()) - BOX_PAD), min(top.shape[1], int(c.max()) + BOX_PAD + 1)


def _pixels(column: pa.Array, i: int) -> np.ndarray:
    """The i-th frame, from bytes of float32 or a list of numbers."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(column[i].as_buffer(), np.float32)
    return column[i].values.to_numpy(zero_copy_only=False).astype(np.float32)


def _each(build: Callable[[pa.RecordBatch, int], tuple], names: list[str], types: list[pa.DataType], rows: int = 16) -> Callable:
    """A map over batches that makes a row of each row, a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = list(zip(*[build(part, i) for i in range(part.num_rows)], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(made, types, strict=True)], names=names)

    return run


def frames(slices: DataFrame, size: int, crop_mm: float) -> DataFrame:
    """(study, series, no, pos, orient, side, frame): each slice cropped around its middle and resized, float32 bytes; no
    frame where its size or spacing isn't valid. slices: (study, series, no, rows, cols, pos, orient, spacing, side,
    pixels)."""
    box = crop_bounds(F.col("rows"), F.col("cols"), F.col("spacing")[0], F.col("spacing")[1], crop_mm)
    ready = slices.select(*KEYS, "no", "pos", "orient", "side", "rows", "cols", box.alias("b"), "pixels").select("*", "b.*").drop("b")

    def build(batch: pa.RecordBatch, i: int) -> tuple:
        row = {k: batch.column(k)[i].as_py() for k in ("study", "series", "no", "pos", "orient", "side", "rows", "cols", "r0", "r1", "c0", "c1")}
        frame = None
        if row["r0"] is not None and batch.column("pixels")[i].is_valid:
            image = _pixels(batch.column("pixels"), i).reshape(row["rows"], row["cols"])[row["r0"] : row["r1"], row["c0"] : row["c1"]]
            frame = resize(image, size, size).astype(np.float32).tobytes()
        return row["study"], row["series"], row["no"], row["pos"], row["orient"], row["side"], frame

    kinds = dict(slices.select(*KEYS).dtypes)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    names = [*KEYS, "no", "pos", "orient", "side", "frame"]
    types = [arrow[kinds["study"]], arrow[kinds["series"]], pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.binary()]
    return ready.withColumn("no", F.col("no").cast("int")).mapInArrow(_each(build, names, types), f"study {kinds['study']}, series {kinds['series']}, no int, pos array<double>, orient array<double>, side string, frame binary")


def _counted(own: DataFrame, targets: bool) -> DataFrame:
    """(study, series, high, low, c): finite values of frames by the upper half of their sortable bits, or, with targets, by
    the lower half for each upper half that is asked for. A task adds up a series' frames before it sends them."""
    kinds = dict(own.select(*KEYS).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wanted, sums = None, [], {}

        def told() -> pa.RecordBatch:
            highs, lows, counts = [], [], []
            for high, c in sums.items():
                at = np.flatnonzero(c)
                highs.append(np.full(len(at), high) if targets else at)
                lows.append(at if targets else np.zeros(len(at), np.int64))
                counts.append(c[at])
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (highs, lows, counts)]
            n = len(flat[0])
            return pa.record_batch([pa.array([key[0]] * n, study), pa.array([key[1]] * n, series), *[pa.array(x, pa.int64()) for x in flat]], names=[*KEYS, "high", "low", "c"])

        study = series = None
        for batch in batches:
            study, series = batch.schema.field("study").type, batch.schema.field("series").type
            for i in range(batch.num_rows):
                own_key = batch.column("study")[i].as_py(), batch.column("series")[i].as_py()
                if own_key != key:
                    if sums:
                        yield told()
                    key, wanted = own_key, batch.column("wanted")[i].as_py() if targets else [0]
                    sums = {h: np.zeros(1 << 16, np.int64) for h in wanted}
                x = np.frombuffer(batch.column("frame")[i].as_buffer(), np.float32)
                u = sortable(x[np.isfinite(x)])
                if targets:
                    for h in wanted:
                        sums[h] += np.bincount(u[u >> 16 == h] & 0xFFFF, minlength=1 << 16)
                else:
                    sums[0] += np.bincount(u >> 16, minlength=1 << 16)
        if sums:
            yield told()

    parts = own.mapInArrow(run, f"study {kinds['study']}, series {kinds['series']}, high long, low long, c long")
    return parts.groupBy(*KEYS, "high", "low").agg(F.sum("c").alias("c"))


def intensity(own: DataFrame) -> DataFrame:
    """(study, series, lo, hi): the QUANTILES of the finite values of a series' frames, interpolated; their least and largest
    value where those are equal. Exact: the upper 16 bits of a value say which of 65,536 bins holds a rank, the lower ones
    where in it."""
    from pyspark.sql import Window

    def held(bins: DataFrame, by: list[str], order: str) -> DataFrame:
        """bins with the ranks that each holds. A window has 65,536 rows at most."""
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return bins.withColumn("before", before)

    high = held(_counted(own.select(*KEYS, "frame"), False), KEYS, "high").withColumn("n", F.sum("c").over(Window.partitionBy(*KEYS)))
    at = [(F.col("n") - 1) * F.lit(q) for q in QUANTILES]
    ranks = F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("n") - 1), *[F.array(F.floor(a).cast("long"), F.ceil(a).cast("long")) for a in at]))
    inside = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))
    high = written(high.select(*KEYS, "high", "n", F.explode(inside).alias("rank"), "before"), "high-bits")
    wanted = high.groupBy(*KEYS).agg(F.sort_array(F.collect_set("high")).alias("wanted"))
    low = held(_counted(own.select(*KEYS, "frame").join(_few(wanted), KEYS), True), [*KEYS, "high"], "low").withColumn("end", F.col("before") + F.col("c"))
    found = high.select(*KEYS, "high", "n", "rank", (F.col("rank") - F.col("before")).alias("r")).join(low, [*KEYS, "high"]).where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("end")))
    told = written(found.groupBy(*KEYS, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", (F.col("high") * 65536 + F.col("low")).alias("u")))).alias("m")), "low-bits")
    forget(high)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for n, entries in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
                m = {r: float(unsortable(np.array([u]))[0]) for r, u in entries}

                def at(q: float, n: int = n, m: dict = m) -> float:
                    p = (n - 1) * q
                    a, b = m[int(np.floor(p))], m[int(np.ceil(p))]
                    return a + (b - a) * (p - np.floor(p))

                a, b = (at(q) for q in QUANTILES)
                a, b = (a, b) if b > a else (m[0], m[n - 1])
                lo.append(a)
                hi.append(b)
            yield pa.record_batch([batch.column("study"), batch.column("series"), pa.array(lo, pa.float64()), pa.array(hi, pa.float64())], names=[*KEYS, "lo", "hi"])

    kinds = dict(own.select(*KEYS).dtypes)
    return told.mapInArrow(bounds, f"study {kinds['study']}, series {kinds['series']}, lo double, hi double")


def projections(own: DataFrame) -> DataFrame:
    """(study, series, top): the largest value of each place over a series' frames. A task sends one frame for each series
    that it meets; those of a series are folded one by one."""
    kinds = dict(own.select(*KEYS).dtypes)
    schema = f"study {kinds['study']}, series {kinds['series']}, top binary"

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top, fields = None, None, None

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key[0]], fields[0]), pa.array([key[1]], fields[1]), pa.array([top.tobytes()], pa.binary())], names=[*KEYS, "top"])

        for batch in batches:
            fields = batch.schema.field("study").type, batch.schema.field("series").type
            for i in range(batch.num_rows):
                own_key = batch.column("study")[i].as_py(), batch.column("series")[i].as_py()
                x = np.frombuffer(batch.column("frame")[i].as_buffer(), np.float32)
                if own_key != key:
                    if key is not None:
                        yield told()
                    key, top = own_key, x
                else:
                    top = np.fmax(top, x)
        if key is not None:
            yield told()

    def folded(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, fields = None, None
        for batch in batches:
            fields = batch.schema.field("study").type, batch.schema.field("series").type
            for x in batch.column("top"):
                x = np.frombuffer(x.as_buffer(), np.float32)
                top = x if top is None else np.fmax(top, x)
        yield pa.record_batch([pa.array([key[0].as_py()], fields[0]), pa.array([key[1].as_py()], fields[1]), pa.array([top.tobytes()], pa.binary())], names=[*KEYS, "top"])

    return own.select(*KEYS, "frame").mapInArrow(partly, schema).groupBy(*KEYS).applyInArrow(folded, schema)


def _ordered(own: DataFrame, planes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((study, series, no, place), a row for each series: study, series, n, normal, side, flip, fault).

    Slices are ordered by their place along the normal of the series' first one, ties by no; places are numbered by ranges,
    so no task orders a series alone. flip says how the series becomes one of the left: its order or its columns reversed.
    """
    first = own.groupBy(*KEYS).agg(slice_normal(F.min_by("orient", "no")).alias("normal"), F.avg(F.get("pos", F.lit(0))).alias("x"), F.max(F.col("frame").isNull()).alias("bad"))
    first = first.join(planes.select(*KEYS, "plane").dropDuplicates(KEYS), KEYS)
    first = written(first, "normals")
    geometry = own.select(*KEYS, "no", "pos", "side").join(_few(first.select(*KEYS, "normal")), KEYS).withColumn("offset", dot(F.col("pos"), F.col("normal")))
    geometry = written(geometry.select(*KEYS, "no", "offset", "side"), "offsets")
    numbered = placed(geometry, [*KEYS, "offset", "no"], "at")
    tag = F.min_by("side", F.when(F.length(F.trim("side")) > 0, F.struct("offset", "no")))
    whole = numbered.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), tag.alias("tag"))
    whole = written(whole, "series")
    fault = F.when(F.col("bad"), "a slice has no valid size or spacing").when(F.col("normal").isNull(), "degenerate orientation")
    side = laterality(F.col("tag"), F.col("x"))
    flip = F.when(side != "R", "none").when(F.lower(F.trim("plane")) == "sagittal", "order").otherwise("columns")
    series = whole.join(_few(first), KEYS).select(*KEYS, "n", "normal", side.alias("side"), flip.alias("flip"), fault.alias("fault"))
    series = written(series, "series")
    places = numbered.join(_few(whole.select(*KEYS, "n", "first")), KEYS).join(_few(series.select(*KEYS, "flip").where("fault is null")), KEYS)
    place = F.when(F.col("flip") == "order", F.col("n") - 1 - (F.col("at") - F.col("first"))).otherwise(F.col("at") - F.col("first"))
    places = written(places.select(*KEYS, "no", place.cast("int").alias("place")), "places")
    forget(first, geometry, whole)
    return places, series


def volume_slices(slices: DataFrame, planes: DataFrame, crop_mm: float = CROP_MM, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """((study, series, place, n, data), (study, series, fault)): each series' slices in order, scaled to 0..1 by the
    quantiles of the whole series and side-normalised, as float32 bytes, a row each; and the series that have none.

    planes: (study, series, plane); series without one are left out. Files with an error are left out before.
    """
    own = written(frames(slices, size, crop_mm), "frames")
    places, series = _ordered(own, planes)
    good = own.join(_few(series.where("fault is null").select(*KEYS, "n", "flip")), KEYS)
    told = good.join(_few(intensity(good)), KEYS)

    def build(batch: pa.RecordBatch, i: int) -> tuple:
        x = np.frombuffer(batch.column("frame")[i].as_buffer(), np.float32).reshape(size, size)
        x = scaled_frame(x, batch.column("lo")[i].as_py(), batch.column("hi")[i].as_py())
        x = x[:, ::-1] if batch.column("flip")[i].as_py() == "columns" else x
        return batch.column("study")[i].as_py(), batch.column("series")[i].as_py(), batch.column("no")[i].as_py(), batch.column("n")[i].as_py(), np.ascontiguousarray(x).tobytes()

    kinds = dict(own.select(*KEYS).dtypes)
    fields = [own.sparkSession.range(0).select(F.lit(None).cast(kinds[k]).alias(k)).toArrow().schema.field(k).type for k in KEYS]
    made = told.mapInArrow(_each(build, [*KEYS, "no", "n", "data"], [*fields, pa.int32(), pa.int64(), pa.binary()]), f"study {kinds['study']}, series {kinds['series']}, no int, n long, data binary")
    return made.join(places, [*KEYS, "no"]).select(*KEYS, "place", "n", "data"), series.where("fault is not null").select(*KEYS, "fault")


def study_cache(slices: DataFrame, planes: DataFrame, slots: DataFrame, crop_mm: float = CROP_MM, frame: int = FRAME, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """((study, slot, place, n, data), (study, slot, series, fault)): the 8-bit cache of studies, a row for each slice that
    stays, places from 0 to n - 1; and the slots whose series can't be worked on.

    slots: (study, slot, series). Each series is made as in volume_slices at `frame`; then it is cut to the box around what
    its projection shows, resized, trimmed to the BAND of its slices and cut off to whole bytes. Slots without a readable
    slice have no row in either table.
    """
    used = slots.select(*KEYS).dropDuplicates(KEYS)
    own = written(frames(slices.join(_few(used), KEYS, "left_semi"), frame, crop_mm), "frames")
    places, series = _ordered(own, planes)
    good = own.join(_few(series.where("fault is null").select(*KEYS, "n", "flip")), KEYS)
    levels = written(intensity(good), "intensity")
    tops = projections(good).join(_few(levels), KEYS).join(_few(series.select(*KEYS, "flip")), KEYS)
    kinds = dict(own.select(*KEYS).dtypes)
    fields = [own.sparkSession.range(0).select(F.lit(None).cast(kinds[k]).alias(k)).toArrow().schema.field(k).type for k in KEYS]
    own_keys = f"study {kinds['study']}, series {kinds['series']}"

    def box(batch: pa.RecordBatch, i: int) -> tuple:
        top = np.frombuffer(batch.column("top")[i].as_buffer(), np.float32).reshape(frame, frame)
        top = scaled_frame(top, batch.column("lo")[i].as_py(), batch.column("hi")[i].as_py())
        found = box_of(top[:, ::-1] if batch.column("flip")[i].as_py() == "columns" else top) or (0, frame, 0, frame)
        return batch.column("study")[i].as_py(), batch.column("series")[i].as_py(), *found

    boxes = tops.mapInArrow(_each(box, [*KEYS, "r0", "r1", "c0", "c1"], [*fields, *[pa.int32()] * 4]), f"{own_keys}, r0 int, r1 int, c0 int, c1 int")
    boxes = written(boxes.join(_few(levels), KEYS), "boxes")
    # the band, in places after the flip
    low = (F.col("n") * F.lit(BAND[0])).cast("int")
    high = F.least(F.col("n"), F.greatest((F.col("n") * F.lit(BAND[1])).cast("int"), low + BAND_LEAST)).cast("int")
    kept = places.join(_few(series.select(*KEYS, "n")), KEYS).where((F.col("place") >= low) & (F.col("place") < high)).select(*KEYS, "no", (F.col("place") - low).alias("place"), (high - low).alias("n"))
    told = own.join(_few(kept), [*KEYS, "no"]).join(_few(boxes), KEYS).join(_few(series.select(*KEYS, "flip")), KEYS)

    def build(batch: pa.RecordBatch, i: int) -> tuple:
        at = {k: batch.column(k)[i].as_py() for k in ("study", "series", "place", "n", "lo", "hi", "flip", "r0", "r1", "c0", "c1")}
        x = scaled_frame(np.frombuffer(batch.column("frame")[i].as_buffer(), np.float32).reshape(frame, frame), at["lo"], at["hi"])
        x = x[:, ::-1] if at["flip"] == "columns" else x
        x = resize(x[at["r0"] : at["r1"], at["c0"] : at["c1"]], size, size).astype(np.float32)
        return at["study"], at["series"], at["place"], at["n"], np.clip(x * np.float32(255), 0, 255).astype(np.uint8).tobytes()

    made = told.mapInArrow(_each(build, [*KEYS, "place", "n", "data"], [*fields, pa.int32(), pa.int32(), pa.binary()]), f"{own_keys}, place int, n int, data binary")
    cache = made.join(_few(slots.select(*KEYS, "slot")), KEYS).select("study", "slot", "place", "n", "data")
    faults = series.where("fault is not null").join(slots.select(*KEYS, "slot"), KEYS).select("study", "slot", "series", "fault")
    forget(levels)
    return cache, faults


def write_cache(cache: DataFrame, path: str) -> None:
    """The cache as Parquet, the slices of a slot side by side and in order, so that a reader of a few takes a range."""
    cache.repartition("study", "slot").sortWithinPartitions("study", "slot", "place").write.mode("overwrite").parquet(path)


def stacks(cache: DataFrame) -> DataFrame:
    """(study, slot, n, data): the bytes of a slot's slices behind one another, for readers that want whole stacks."""
    each = cache.groupBy("study", "slot").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("s"))
    joined = F.aggregate("s", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    return each.select("study", "slot", F.size("s").alias("n"), joined.alias("data"))
