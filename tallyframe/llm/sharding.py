"""Operator 8: minimax contiguous partition of groups into shards, with DataFrame functions only.

Groups of equal texts are atomic and ordered by their first document. The smallest shard capacity for which a greedy
walk over that order needs no more than the given number of shards is found by binary search, and the order is cut
within that capacity, as evenly as the groups allow. The walk runs on the driver over a bounded index of running sizes, made finer only around the
places where a cut can still be.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Entries of the index of running sizes that the driver holds at a time; doubled if a finer index leaves the places of
#: the cuts as wide as before, which takes more sizes there than the index has entries.
INDEX = 1 << 15


def _walk(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Running size at each cut of the greedy walk: every shard takes groups while they fit."""
    cuts, at = [], 0
    for _ in range(shards):
        i = bisect_right(ends, at + capacity)
        at = max(at, ends[i - 1]) if i else at
        cuts.append(at)
    return cuts


def _walk_at_most(steps: list[int], ends: list[int], step: int, capacity: int, shards: int) -> list[int]:
    """A bound that no cut of the walk exceeds, if ends[i] is the last of all running sizes in steps[i]."""
    cuts, at = [], 0
    for _ in range(shards):
        i = bisect_right(steps, (at + capacity) // step)
        at = max(at, min(at + capacity, ends[i - 1])) if i else at
        cuts.append(at)
    return cuts


def _smallest(low: int, high: int, enough) -> int:
    """The smallest number in low..high that is enough, found by bisection; high must be."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, index: int = INDEX) -> tuple[int, list[int]]:
    """(capacity, running size at each cut) for the running sizes in column `end`, exactly.

    The driver holds an index of at most `index` equal steps of the size axis with the last running size in each. A
    walk that cuts at indexed sizes only shows capacities that are enough; a walk that cuts as late as a step allows
    shows those that aren't. The n-th cut lies between both walks, so only running sizes in those ranges stay, and the
    next index over them is finer, until a step has one running size at most.
    """
    low, high = max(largest, -(-total // shards)), total
    ranges = [(0, total)]
    while True:
        width = sum(b - a + 1 for a, b in ranges)
        step = max(1, -(-width // index))
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | F.col("end").between(a, b)
        inner = ends.where(inside)
        if inner.limit(index + 1).count() <= index:
            step = 1
        found = inner.groupBy(F.floor(F.col("end") / step).cast("long").alias("k")).agg(F.max("end").alias("end"), F.count("*").alias("n"))
        rows = sorted(found.collect(), key=lambda r: r.k)  # index + 2 x shards rows at most
        steps, known = [r.k for r in rows], [r.end for r in rows]
        high = _smallest(low, high, lambda c: _walk(known, c, shards)[-1] == total)
        if step == 1 or all(r.n == 1 for r in rows):
            return high, _walk(known, high, shards)
        low = _smallest(low, high, lambda c: _walk_at_most(steps, known, step, c, shards)[-1] == total)
        merged: list[tuple[int, int]] = []
        for a, b in zip(_walk(known, low, shards), _walk_at_most(steps, known, step, high, shards), strict=True):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        if sum(b - a + 1 for a, b in merged) >= width:
            index *= 2
        ranges = merged


def even_cuts(ends: DataFrame, capacity: int, total: int, shards: int) -> list[int]:
    """Running size at each cut so that no shard exceeds capacity and each cut is the last one up to its even share.

    The walk from the end back gives the earliest place of each cut; from there on, a cut goes to the last end that
    neither its even share nor the capacity of the shard before it excludes. Each step looks up one end.
    """

    def last(to: int) -> int:
        return ends.where(F.col("end") <= to).agg(F.max("end")).first()[0] or 0

    earliest = [total]
    for _ in range(shards - 1):
        back = earliest[0] - capacity
        earliest.insert(0, 0 if back <= 0 else ends.where(F.col("end") >= back).agg(F.min("end")).first()[0])
    cuts, at = [], 0
    for i, least in enumerate(earliest):
        at = total if i == shards - 1 else max(least, last(min(at + capacity, total * (i + 1) // shards)))
        cuts.append(at)
    return cuts


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of `value` up to each row in `order` (a total order), by ranges of the order instead of in one task."""
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    spread = common.written(spread, "ranges")
    parts = spread.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row for each range
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spread.join(F.broadcast(parts), "_part").withColumn(out, F.col("_before") + own).drop("_part", "_before")


def place_by_cuts(start: Column, cuts: list[int]) -> Column:
    """Index of the first cut that is greater than start: a bounded number of comparisons."""
    return sum((F.when(start >= c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")


def shard_contiguous(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = 256) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot; the largest shard is as small as it can be.

    size: UTF-8 bytes of the text plus 8; null text: none, so 8, crc32 0, a group of its own kind (apart from the
    empty text). Equal texts share a shard. slot numbers a shard's rows from 0 without gaps. Groups are ordered by their
    least id, nulls first, ties by the digest. Very long texts count whole; one that is larger than an even share has a
    shard's capacity to itself. Repeated rows each get a slot. Extra columns, whatever their names, are not carried. An
    empty table gives an empty table.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"").cast("binary")).alias("digest"),
    )
    rows = common.written(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.count("*").alias("rows"), F.sum("size").alias("group_size"), F.coalesce(F.min("doc_id"), F.lit(-(1 << 63))).alias("first_id"))
    groups = common.written(running_sum(groups, ["first_id", "digest"], "group_size", "end"), "groups")
    total, largest, n_rows = groups.agg(F.max("end"), F.max("group_size"), F.sum("rows")).first()
    cuts = even_cuts(groups, minimax_cuts(groups, total, largest, shards)[0], total, shards) if total else []
    shard = place_by_cuts(F.col("end") - F.col("group_size"), cuts) if total else F.lit(0)
    placed = common.join_groups(rows, groups.select("digest", "rows", shard.alias("shard")), ["digest"], "rows", n_rows or 0)
    # slots: a shard's rows are numbered in buckets, one after another, so that no task numbers a whole shard
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(slot_buckets)).cast("int")
    placed = common.written(placed.select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards x slot_buckets rows at most
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.join(F.broadcast(counts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_contiguous(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
