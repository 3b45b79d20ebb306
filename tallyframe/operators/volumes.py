"""Image stacks as arrays: scaling, cropping, ordering, and the tensors of slots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot, order_by_position, slice_normal
from .quantiles import quantiles


def intensity_bounds(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, lo, hi): 1st and 99th percentile, interpolated, of the finite values; the least and largest one where those
    are equal."""
    q = lambda i: F.col("qs")[i]
    flat = q(1) >= q(2)
    return quantiles(pixels, keys, value, [0.0, 0.01, 0.99, 1.0]).select(*keys, F.when(flat, q(0)).otherwise(q(1)).alias("lo"), F.when(flat, q(3)).otherwise(q(2)).alias("hi"))


def normalised(value: Column, lo: Column, hi: Column) -> Column:
    """A value clipped to lo..hi and scaled to 0..1; 0 where that range is empty or the value isn't a number."""
    v = F.coalesce(F.when(~F.isnan(value), value), lo)
    scaled = F.try_divide(F.greatest(lo, F.least(hi, v)) - lo, hi - lo)
    return F.when(hi > lo, scaled).otherwise(0.0)


def normalised_array(values: Column) -> Column:
    """normalised() of a whole array by its own percentiles, found in the sorted finite values; by the least and largest
    one where those are equal."""
    finite = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))

    def quantile(q: float) -> Column:
        at = (F.size(finite) - 1) * q
        low = F.floor(at).cast("int")
        a, b = F.get(finite, low), F.get(finite, F.ceil(at).cast("int"))
        return a + (b - a) * (at - low)

    pick = lambda a, b: F.when(quantile(0.01) < quantile(0.99), a).otherwise(b).cast("double")
    own = F.struct(pick(quantile(0.01), F.get(finite, F.lit(0))).alias("lo"), pick(quantile(0.99), F.get(finite, F.size(finite) - 1)).alias("hi"))
    bounds = F.transform(F.array(own), lambda b: F.transform(values, lambda v: F.coalesce(normalised(v.cast("double"), b["lo"], b["hi"]), F.lit(0.0))))
    return F.element_at(bounds, 1)


def side_normalised(stack: Column, plane: Column, side: Column) -> Column:
    """A stack (array of slices, each an array of rows) of a right side as if left: sagittal stacks reversed, others
    mirrored row by row; any other side as it is."""
    mirrored = F.transform(stack, lambda s: F.transform(s, lambda r: F.reverse(r)))
    return F.when(F.coalesce(F.upper(side) != "R", F.lit(True)), stack).when(F.lower(F.trim(plane)) == "sagittal", F.reverse(stack)).otherwise(mirrored)


def padded(values: Column, length: int, fill: float = 0.0) -> Column:
    """An array with `fill` behind it up to a length."""
    return F.concat(values, F.array_repeat(F.lit(fill).cast("double"), F.greatest(F.lit(0), F.lit(length) - F.size(values))))


def slot_stack(groups: DataFrame, slots: list[str], size: int) -> DataFrame:
    """(study, data, mask): for each slot its array, zeros where the study has none, and whether it has one."""
    wide = groups.groupBy("study").agg(F.map_from_entries(F.collect_list(F.struct("slot", "data"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0).cast("double"), size)
    return wide.select("study", F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), zeros) for s in slots]).alias("data"), F.array(*[F.try_element_at("m", F.lit(s)).isNotNull() for s in slots]).alias("mask"))


def max_projection_box(pixels: DataFrame, keys: list[str], threshold: float, least: int = 100, pad: int = 4) -> DataFrame:
    """(keys, r0, r1, c0, c1, n): padded bounds of the places whose largest value over slices exceeds a threshold, from
    (keys, slice, r, c, v); without bounds where fewer than `least` places do."""
    top = pixels.groupBy(*keys, "r", "c").agg(F.max("v").alias("v")).where(F.col("v") > threshold)
    box = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("a"), F.max("r").alias("b"), F.min("c").alias("d"), F.max("c").alias("e"))
    known = F.col("n") >= least
    at = lambda c: F.when(known, c)
    return box.select(*keys, at(F.greatest(F.lit(0), F.col("a") - pad)).alias("r0"), at(F.col("b") + pad + 1).alias("r1"), at(F.greatest(F.lit(0), F.col("d") - pad)).alias("c0"), at(F.col("e") + pad + 1).alias("c1"), "n")


def ordered_slices(slices: DataFrame) -> DataFrame:
    """(series, idx, normal, offsets): order of a series' slices along the first slice's normal, from (series, no, pos,
    orient). Slices of a series, a few hundred, are gathered in one array."""
    own = slices.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("no", "pos", "orient"))).alias("s"))
    own = own.withColumn("normal", slice_normal(F.col("s")[0]["orient"]))
    offsets = F.transform("s", lambda x: dot(x["pos"], F.col("normal")))
    own = own.withColumn("offsets", offsets)
    return own.select("series", F.transform(order_by_position(F.col("offsets")), lambda i: F.get(F.col("s"), i)["no"]).alias("idx"), "normal", "offsets")


def resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned."""
    r = np.clip((np.arange(rows) + 0.5) * image.shape[0] / rows - 0.5, 0, image.shape[0] - 1)
    c = np.clip((np.arange(cols) + 0.5) * image.shape[1] / cols - 0.5, 0, image.shape[1] - 1)
    r0, c0 = r.astype(int), c.astype(int)
    r1, c1 = np.minimum(r0 + 1, image.shape[0] - 1), np.minimum(c0 + 1, image.shape[1] - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    top = image[r0][:, c0] * (1 - fc) + image[r0][:, c1] * fc
    low = image[r1][:, c0] * (1 - fc) + image[r1][:, c1] * fc
    return top * (1 - fr) + low * fr
