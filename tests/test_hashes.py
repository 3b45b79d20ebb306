"""Hashes side by side against hashlib, and the bootstrap's counts by score."""

import hashlib
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tallyframe.functions import hashes
from tallyframe.functions.hashes import first_words
from tallyframe.operators import bootstrap


def test_first_words():
    first, second = np.array([1, 9, 10, 345, 3000]), np.array([7, 8, 99, 100, 12345678])
    for head in (b"2026|quality|1|", b"", b"x" * 42, b"y" * 80, "2026|Ж|0|".encode()):
        want = [[int(hashlib.sha256(head + b"%d|%d" % (i, j)).hexdigest()[:8], 16) for j in second] for i in first]
        assert first_words(head, first, b"|", second).tolist() == want


def test_rounds_write_over(monkeypatch):
    """Hashes of many texts take the room they have, its size chosen once, and the result; rounds make no new arrays."""
    monkeypatch.setattr(hashes, "LANES", 1 << 14)
    first, second = np.arange(1000, 1400), np.arange(1000, 3000)
    tracemalloc.start()
    first_words(b"2026|quality|1|", first, b"|", second)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - 4 * len(first) * len(second) < 36 * 4 * (1 << 14)


def test_places_beyond_32_bits(spark):
    """The packed numbers of a large stratum take 64 bits, those of a smaller one 32; either names the places of the hashes."""
    for size in (2000, 1 << 20, 1 << 23):
        rows = spark.range(1, 6).select(F.lit("A").alias("label"), F.lit("1").alias("y"), F.lit(size).alias("size"), F.col("id").alias("place"))
        got = []
        for r in bootstrap._named(rows.coalesce(1), 1000, 2026).collect():
            steps = np.frombuffer(r.steps, np.uint16 if len(r.steps) == 2 * (r.n - 1) else np.uint32).astype(int)
            codes = r.first + np.concatenate([[0], np.cumsum(steps)])
            got += [((r.block << bootstrap.BLOCK) + c // 1001, c % 1001) for c in codes.tolist()]
        want = [(int(hashlib.sha256(f"2026|A|1|{d}|{p}".encode()).hexdigest()[:8], 16) % size, d) for d in range(1, 1001) for p in range(1, 6)]
        assert sorted(got) == sorted(want)


def test_places_travel_packed(spark):
    """What goes to a block of places is about two bytes a draw and row, not four."""
    rows = spark.range(1, 3001).select(F.lit("A").alias("label"), F.lit("1").alias("y"), F.lit(3000).alias("size"), F.col("id").alias("place"))
    sent = bootstrap._named(rows.coalesce(1), 400, 2026)
    assert sent.agg(F.sum("n")).first()[0] == 3000 * 400
    assert sent.agg(F.sum(F.length("steps"))).first()[0] < 2.1 * 3000 * 400
