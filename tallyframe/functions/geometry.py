"""Columns for slice geometry: normals, positions, sides and crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_normal(orientation: Column) -> Column:
    """Unit normal (array of 3) of an orientation (array of 6: row and column direction); null where it has none."""
    o = [F.get(orientation, F.lit(i)) for i in range(6)]
    n = [o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3]]
    norm = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return F.when((F.size(orientation) == 6) & (norm > 1e-9), F.array(*[c / norm for c in n]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, v: s + v)


def order_by_position(positions: Column) -> Column:
    """Indices of an array of positions from the least on; equal positions keep their order."""
    pairs = F.transform(positions, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def laterality(tag: Column, x: Column) -> Column:
    """L or R from a tag's first letter, else from the sign of x (0 or more: L), else L."""
    head = F.upper(F.substring(F.trim(F.coalesce(tag, F.lit(""))), 1, 1))
    return F.when(head.isin("L", "R"), head).when(F.coalesce(x, F.lit(0.0)) >= 0, "L").otherwise("R")


def crop_bounds(rows: Column, cols: Column, row_spacing: Column, col_spacing: Column, crop_mm: float) -> Column:
    """struct<r0, r1, c0, c1>: the half-open, centred crop of crop_mm, kept inside the frame; null if sizes are invalid."""

    def bounds(n: Column, spacing: Column) -> tuple[Column, Column]:
        size = F.greatest(F.lit(1), F.least(n, F.bround(F.lit(crop_mm) / spacing).cast("int")))
        start = ((n - size) / 2).cast("int")
        return start, start + size

    r0, r1 = bounds(rows, row_spacing)
    c0, c1 = bounds(cols, col_spacing)
    valid = (rows > 0) & (cols > 0) & (row_spacing > 0) & (col_spacing > 0) & (F.lit(crop_mm) > 0)
    return F.when(valid, F.struct(r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1")))
