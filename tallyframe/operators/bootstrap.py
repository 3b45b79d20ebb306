"""Stratified bootstrap of the change of the AUC, all draws at once.

A row is in a draw as often as the draw's hashes name its place. Instead of a row for each draw and place, the named
places travel as sorted, packed numbers to the block of places that holds them, where they are counted: a byte for each
draw and row. Counts of equal scores are added up before they go, by ranges of scores, to where one running sum along the
scores gives the AUCs of all draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import first_words
from ..steps import written
from .splits import placed

#: Places of a block, as a power of 2, and packed places that a task holds before it sends them on.
BLOCK, HELD = 10, 4_000_000
#: Ranges of scores of a label, and scores whose counts a task holds before it sends them on.
RANGES, SCORES = 64, 4096


def drawn_places(seed: int, label: str, y: str, size: int, draws: int, places: np.ndarray) -> np.ndarray:
    """The places, from 0, that some places stand for in each draw, a row for each draw: the first 32 bits of SHA-256 of
    seed|label|y|draw|place, modulo the number of places."""
    heads = first_words(f"{seed}|{label}|{y}|".encode(), np.arange(1, draws + 1), b"|", places)
    return heads - heads // np.uint32(size) * np.uint32(size)


def _named(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """(label, y, block, n, first, steps): for each block of places the n numbers place * (draws + 1) + draw that draws
    name in it, in order: the first one, and the steps between them in 16 or 32 bits."""
    width = draws + 1

    def packed(label: str, y: str, size: int, places: list[int]) -> Iterator[tuple]:
        kind = np.uint32 if (size + 1) * width < 1 << 32 else np.uint64
        at = drawn_places(seed, label, y, size, draws, np.array(places)).astype(kind, copy=False)
        at *= kind(width)
        at += np.arange(1, width, dtype=kind)[:, None]
        codes = np.sort(at, axis=None)
        span = width << BLOCK
        steps = np.diff(codes)
        ends = np.minimum(np.arange(size // (1 << BLOCK) + 2, dtype=np.uint64) * np.uint64(span), np.uint64(size * width + draws))
        bounds = np.searchsorted(codes, ends.astype(kind))
        for block in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[block], bounds[block + 1]
            own = steps[a : b - 1]
            short = not len(own) or own.max() < 1 << 16
            yield label, y, block, b - a, int(codes[a]) - block * span, own.astype(np.uint16 if short else np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, int], list[int]] = {}
        most = max(1, HELD // draws)

        def sent(key: tuple[str, str, int]) -> Iterator[pa.RecordBatch]:
            told = list(zip(*packed(*key, held.pop(key)), strict=True))
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(told, types, strict=True)], names=["label", "y", "block", "n", "first", "steps"])

        for batch in batches:
            for *key, place in zip(*(batch.column(c).to_pylist() for c in ("label", "y", "size", "place")), strict=True):
                own = held.setdefault(tuple(key), [])
                own.append(place)
                if len(own) >= most:
                    yield from sent(tuple(key))
        for key in list(held):
            yield from sent(key)

    return rows.select("label", "y", "size", "place").mapInArrow(run, "label string, y string, block long, n long, first long, steps binary")


def _bytes(counts: np.ndarray) -> bytes:
    """Counts in 8 bits each if they are that small, else in 32."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def _counts(told: bytes, width: int) -> np.ndarray:
    return np.frombuffer(told, np.uint8 if len(told) == width else np.int32)


_COUNTED = "label string, which string, part int, p double, is_pos boolean, counts binary"
_TYPES = {"label": pa.string(), "which": pa.string(), "part": pa.int32(), "p": pa.float64(), "is_pos": pa.bool_(), "counts": pa.binary()}


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_TYPES), _TYPES.values(), strict=True)]


def bootstrap_agreement(scores: DataFrame, draws: int, seed: int = 2026) -> DataFrame:
    """(label, point, agreement) from (id, label, y, prev, new): the change of the AUC, and the share of stratified
    bootstrap draws with a change of the same sign; draws without change never agree. Both are null where a class is
    missing.

    Draws come from a hash of seed, draw and place, so they are the same on any cluster; each label's positives and
    negatives are drawn apart. Rows are numbered by ranges, so a label with most of the rows isn't one task; a task holds
    the counts of one block of places, or a few vectors of a number for each draw. A null score ranks first.
    """
    numbered = placed(scores.where("y is not null").select("label", "y", "id", "prev", "new"), ["label", "y", "id"], "at")
    strata = numbered.groupBy("label", "y").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    rows = numbered.join(F.broadcast(strata), ["label", "y"])  # two rows for each label
    place = F.col("at") - F.col("first")
    rows = rows.select("label", (F.col("y") == 1).alias("is_pos"), F.col("y").cast("string").alias("y"), "size", (place + 1).alias("place"), F.shiftright(place, BLOCK).alias("block"), F.col("prev").cast("double").alias("prev"), F.col("new").cast("double").alias("new"))
    rows = written(rows, "drawn-rows")
    width = draws + 1  # before the draws, each row once
    # all cores hash, however few rows there are
    tasks = max(1, min(256, int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = [i / RANGES for i in range(1, RANGES)]
    # a row for each label
    bounds = {r.label: {w: np.array(sorted(x for x in r[w] or () if x == x)) for w in ("prev", "new")} for r in rows.groupBy("label").agg(*[F.percentile_approx(w, cuts, 1000).alias(w) for w in ("prev", "new")]).collect()}

    def counted(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The counts of a block's places in all draws, added up by either score."""
        if not left.num_rows:
            return pa.table(_columns([]), names=list(_TYPES))
        codes = [np.empty(0, np.int64)]
        for n, first, steps in zip(*(right.column(c).to_pylist() for c in ("n", "first", "steps")), strict=True):
            own = np.empty(n, np.int64)
            own[0] = first
            own[1:] = np.frombuffer(steps, np.uint16 if len(steps) == 2 * (n - 1) else np.uint32)
            codes.append(np.cumsum(own))
        times = np.bincount(np.concatenate(codes), minlength=width << BLOCK)
        times = times.astype(np.uint8 if times.max() < 256 else np.int32).reshape(1 << BLOCK, width)
        times[:, 0] = 1
        own = times[(left.column("place").to_numpy() - 1) & ((1 << BLOCK) - 1)]
        label, is_pos = key[0].as_py(), left.column("is_pos")[0].as_py()
        out: list[tuple] = []
        for which in ("prev", "new"):
            coded = left.column(which).combine_chunks().dictionary_encode(null_encoding="encode")
            at = coded.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            sums = [own[same[0]] if len(same) == 1 else own[same].sum(0, dtype=np.int32) for same in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)]
            values = coded.dictionary.to_pylist()
            parts = np.searchsorted(bounds[label][which], np.array([-math.inf if p is None else p for p in values], float), side="right").tolist()
            out += [(label, which, 0 if p is None else part + 1, p, is_pos, _bytes(c)) for p, part, c in zip(values, parts, sums, strict=True)]
        return pa.table(_columns(out), names=list(_TYPES))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of equal scores added up, as far as a task sees them together."""
        held: dict[tuple, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            rows = [(*k, _bytes(v)) for k, v in held.items()]
            held.clear()
            return pa.record_batch(_columns(rows), names=list(_TYPES))

        for batch in batches:
            for *key, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(math.nan if x != x else x for x in key)
                if (own := held.get(key)) is not None:
                    own += _counts(counts, width)
                    continue
                if len(held) >= SCORES:
                    yield told()
                held[key] = _counts(counts, width).astype(np.int32)
        if held:
            yield told()

    keys = ["label", "y", "block"]
    counts = rows.groupBy(*keys).cogroup(_named(rows.repartition(tasks, "label", "y", "place"), draws, seed).groupBy(*keys)).applyInArrow(counted, _COUNTED)
    order = ["label", "which", "part"]
    part = counts.mapInArrow(added, _COUNTED).repartition(tasks, *order).sortWithinPartitions(*order, "p")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range of a label: won pairs within it, positives and negatives, for each draw."""
        own, p = None, None
        won, pos, neg, tied = np.zeros(width), np.zeros(width), np.zeros(width), [np.zeros(width), np.zeros(width)]
        some = [False, False]

        def step() -> None:
            """Take in the rows of one score."""
            if some[1]:
                won.__iadd__(tied[1] * (neg + tied[0] / 2 if some[0] else neg))
                pos.__iadd__(tied[1])
            if some[0]:
                neg.__iadd__(tied[0])
            for k in range(2):
                if some[k]:
                    tied[k][:] = 0
                    some[k] = False

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([own[0]]), pa.array([own[1]]), pa.array([own[2]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (won, pos, neg)]], names=["label", "which", "part", "won", "pos", "neg"])

        for batch in batches:
            for label, which, no, score, is_pos, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, which, no) != own:
                    step()
                    if own is not None:
                        yield told()
                    own, p = (label, which, no), score
                    for v in (won, pos, neg):
                        v[:] = 0
                elif score != p and not (score is not None and p is not None and score != score and p != p):
                    step()
                    p = score
                tied[is_pos] += _counts(counts, width)
                some[is_pos] = True
        if own is not None:
            step()
            yield told()

    ranges = part.mapInArrow(summed, "label string, which string, part int, won binary, pos binary, neg binary")

    def judged(key: tuple, group: pa.Table) -> pa.Table:
        """A label's AUCs of all draws from its ranges, RANGES + 1 at most for either side."""
        auc = {}
        for which in ("prev", "new"):
            won, pos, neg = np.zeros(width), np.zeros(width), np.zeros(width)
            mine = [r for r in group.sort_by("part").to_pylist() if r["which"] == which]
            for r in mine:
                w, p, n = (np.frombuffer(r[c], np.float64) for c in ("won", "pos", "neg"))
                won, pos, neg = won + w + p * neg, pos + p, neg + n
            auc[which] = won / np.where(pos * neg > 0, pos * neg, np.nan)
        d = auc["new"] - auc["prev"]
        known = bool(d[0] == d[0])
        same = ((d[1:] > 0) == (d[0] > 0)) & (d[1:] != 0)
        return pa.table({"label": pa.array([key[0].as_py()], pa.string()), "point": pa.array([d[0] if known else None], pa.float64()), "agreement": pa.array([same.sum() / draws if known else None], pa.float64())})

    return ranges.groupBy("label").applyInArrow(judged, "label string, point double, agreement double")
