"""Operator 3: n-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

A document is the set of its distinct word n-grams. Sets of similar size that are similar enough differ in at most k
elements. The domain of n-grams is split into groups by a hash, and each group into parts; of two such sets, some group
holds at most k2 of the differences, so they agree on all but k2 of its parts. A set's signatures are, for each group,
its elements in each choice of all but k2 parts: similar sets share one. Sets that share a signature are candidates, and
candidates are compared in full unless others already tie them together. Where one signature brings very many different
sets together, as a common boilerplate does, only those that also share one of their rarest elements are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Cells of a sketch, as a power of 2.
CELL_BITS = 8
#: Elements of the sets of one tile of a family, about twice: bounds a task's memory at some 100 MB.
TILE = 200_000
#: Sketches of one tile of a family, about twice.
SKETCHES = 2000
#: Tiles that a family may take before its members meet only where they share a rare element.
MOST_TILES = 8
#: Bits of a class's digest that travel with each of its signatures.
MARK_BITS = 40
#: Rows that a broadcast of ids may have.
MOST_BROADCAST = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; with fewer words, of all words as one; without words, empty.

    Words are runs of [^\\x20\\x09-\\x0D] after A-Z went to lower case, which is how bytes split and lower themselves.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out ^ hashed[i : len(words) - size + 1 + i])
    return np.unique(out)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set of hashes from others."""
    import xxhash

    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall in each of CELLS cells of a hash, up to 255: two sets differ in at least as many elements
    as their sketches differ."""
    return np.minimum(np.bincount((mix(s) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS), 255).astype(np.uint8).tobytes()


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets may be similar enough, from their sketches: false only if they can't be."""
    return np.abs(a.astype(np.int16) - b).sum(-1) * (den + num) <= (den - num) * (size_a + size_b)


class Scheme:
    """Signatures for a Jaccard bound num / den.

    Sizes fall into bands of ratio `ratio`, at least den / num, so that a set's partner is in its own band or the next.
    Level b serves the pairs whose larger set is in band b. Parts in which a set has no element would make large
    buckets that tell nothing, yet two sets may agree on nothing else. So each level has more groups than k asks for,
    enough that two sets agree on more signatures than either has empty ones, and only a set with more empty ones than
    `spare` signs those too. No pair is missed.
    """

    def __init__(self, num: int, den: int, parts: int = 3, k2: int = 1, ratio: float = 1.25):
        self.num, self.den, self.parts, self.k2 = num, den, parts, k2
        self.ratio = max(ratio, den / num)
        self.starts = [1]
        self.choices = np.array([[p in c for p in range(parts)] for c in combinations(range(parts), parts - k2)])

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] * self.ratio)))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019  one scheme per process
    def level(self, b: int) -> tuple[int, int, int]:
        """(k, groups, spare) of level b: similar sets agree on more than `spare` signatures."""
        while len(self.starts) <= b + 1:
            self.band(self.starts[-1])
        top, least = self.starts[b + 1] - 1, self.starts[b] * self.num / self.den
        k = (self.den - self.num) * 2 * top // (self.den + self.num)
        need, groups = -(-(k + 1) // (self.k2 + 1)), 0
        for groups in range(need, 3 * need + 1):
            empty = groups * len(self.choices) * math.exp(-least * (self.parts - self.k2) / (self.parts * groups))
            if (spare := self.agreeing(groups, k) - 1) >= empty + 3 * math.sqrt(empty):
                break
        return k, groups, spare

    def agreeing(self, groups: int, k: int) -> int:
        """The least number of signatures, empty ones included, that two sets share that differ in at most k elements:
        at worst k2 + 1 differences spoil each group they fall in, and the rest one more in part."""
        full, rest = divmod(k, self.k2 + 1)
        return len(self.choices) * (groups - full) - (len(self.choices) - math.comb(self.parts - rest, self.parts - self.k2))

    def levels(self, size: int) -> list[int]:
        """The levels at which a set of this size has partners of other elements."""
        b = self.band(size)
        found = [b, b + 1] if size * self.den >= self.num * self.starts[b + 1] else [b]
        return [x for x in found if self.level(x)[0] > 0]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        out = []
        for b in self.levels(len(s)):
            _, groups, spare = self.level(b)
            h = mix(s ^ np.uint64(b + 1))
            cell = ((h >> np.uint64(32)) * np.uint64(groups * self.parts) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(groups * self.parts, np.uint64)
            np.add.at(sums, cell, mix(h))
            filled = np.bincount(cell, minlength=len(sums)).reshape(groups, self.parts) > 0
            sums = sums.reshape(groups, self.parts)
            own = np.stack([sums[:, c].sum(1, dtype=np.uint64) for c in self.choices], 1)
            some = np.stack([filled[:, c].any(1) for c in self.choices], 1)
            place = np.arange(own.size, dtype=np.uint64).reshape(own.shape) + np.uint64(b << 40)
            signed = mix(own ^ mix(place))
            out.append(signed.ravel() if (~some).sum() > spare else signed[some])
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def similar(sets: list[np.ndarray], component: np.ndarray, num: int, den: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets in different components whose similarity is at least num / den, compared all at once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[where] > 1
    row, where = row[shared], np.unique(where[shared], return_inverse=True)[1]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(where[-1]) + 1 if len(where) else 0, columns):
        lo, hi = np.searchsorted(where, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[lo:hi], where[lo:hi] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    a, b = np.nonzero(np.triu(den * both >= num * (sizes[:, None] + sizes - both), 1))
    apart = component[a] != component[b]
    return a[apart], b[apart]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that edges (a, b) reach."""
    root = np.arange(n)
    while True:
        least, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))


#: Digests that a task remembers, to sign copies in it once.
SEEN = 200_000


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, k2: int = 1, ratio: float = 1.25) -> DataFrame:
    """(doc, n_shingles, component): components of the documents whose sets of word n-grams have a Jaccard similarity of
    at least num / den; component is the smallest id reached.

    Empty and null texts have no shingles and link with nothing. Rows that repeat an id are one document with several
    texts: each keeps its row, all are in one component. A null id has a null component. Very long texts are read whole.
    Pairs at the bound exactly (ties) link. Extra columns, whatever their names, are not carried. An empty table gives an
    empty table.
    """
    return _components(docs, n, num, den, id_col, text_col, parts, k2, ratio)[0]


def _components(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, k2: int = 1, ratio: float = 1.25) -> tuple[DataFrame, list[DataFrame]]:
    """The result of jaccard_components and the written steps it still reads.

    Sets are signed and compared by class, the digest (hi, lo) of their elements; ids come in when classes are tied.
    """
    scheme, cut = (num, den, parts, k2, ratio), 64 - MARK_BITS

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), n) for t in batch.column(1)]
            marks = [digest(s) if len(s) else (None, None) for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(map(sketch, sets), pa.binary())], names=["doc", "n_shingles", "hi", "lo", "sketch"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Scheme(*scheme), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                marks, found = [], []
                for doc, text in zip(batch.column(0)[at : at + 500].to_pylist(), batch.column(1)[at : at + 500], strict=True):
                    s = shingles(text.as_py(), n)
                    # copies within a task sign once, so a group of copies adds a row for each task at most
                    if doc is not None and len(s) and (mark := digest(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(mark)
                        found.append(own.signatures(s))
                        marks.append(np.full(len(found[-1]), (mark[0] & (1 << 64) - 1) >> cut))
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(marks))], names=["sig", "mark"])

    rows = _rows(docs, id_col, text_col)
    sets = common.written(rows.mapInArrow(sized, "doc long, n_shingles long, hi long, lo long, sketch binary"), "sets")
    # classes: equal sets, by a number, with the smallest id of their documents
    classes = sets.where("hi is not null and doc is not null").groupBy("hi", "lo").agg(F.min("doc").alias("rep"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = common.written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    marks = classes.select(F.shiftrightunsigned("hi", cut).alias("mark"), "class", "size")
    n_rows = classes.agg(F.sum("copies")).first()[0] or 0
    named = common.join_groups(sets.where("hi is not null and doc is not null").select("doc", "hi", "lo"), classes.select("hi", "lo", "class", "copies"), ["hi", "lo"], "copies", n_rows)
    copies = common.written(named.select("doc", "class"), "copies")
    # buckets of two classes or more; the exchange by signature is the only one of all signatures, and most of the disk, so
    # that some bits of the digest stand for a class there: classes that have them in common are all taken for members
    each = Window.partitionBy("sig")
    ends = {"low": F.min("mark").over(each), "high": F.max("mark").over(each), "n": F.count("*").over(each)}
    shared = common.written(rows.mapInArrow(signed, "sig long, mark long").withColumns(ends).where("low < high").select("sig", "mark", "n"), "buckets")
    weights = shared.groupBy("mark").agg(F.sum("n").alias("weight"))
    # a bucket of such classes alone looks like one class: what they have in common is a signature of theirs, too
    twins = marks.groupBy("mark").agg(F.count("*").alias("weight")).where("weight > 1")
    twins = marks.join(twins, "mark").select(F.col("mark").alias("sig"), F.col("class").alias("doc"), "size", "weight")
    # of copies signed in several tasks, one row stays
    named = shared.join(marks.join(weights, "mark"), "mark").select("sig", F.col("class").alias("doc"), "size", "weight")
    buckets = common.written(_with_hubs(named.distinct().union(twins)), "buckets")
    common.forget(shared)
    return _finish(rows, sets, classes, copies, buckets, n_rows, n, num, den)


def _with_hubs(rows: DataFrame) -> DataFrame:
    """The rows (sig, doc, size) whose signature several classes have, with one of those as `first`: the one of the largest
    weight, which is how often others share its signatures. The text that near copies were made from is likelier to be
    similar to each of them than they are to each other, and shares more signatures."""
    each = Window.partitionBy("sig")
    hub = F.max(F.struct("weight", "doc")).over(each)["doc"]
    return rows.withColumns({"low": F.min("doc").over(each), "high": F.max("doc").over(each), "first": hub}).where("low < high").select("sig", "doc", "size", "first")


def _finish(rows: DataFrame, sets: DataFrame, classes: DataFrame, copies: DataFrame, buckets: DataFrame, n_rows: int, n: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Components of all documents and the written steps they still read, from the buckets of signatures that their classes share; but for the last step, `doc`
    is a class."""

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                marks, found = [], []
                for text in batch.column(1)[at : at + 500]:
                    s = shingles(text.as_py(), n)
                    if len(s) and (mark := digest(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(mark)
                        marks.append(mark)
                        found.append(s.tobytes())
                if found:
                    yield pa.record_batch([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(found, pa.binary())], names=["hi", "lo", "set"])

    def whole(docs: DataFrame) -> DataFrame:
        """(doc, set) of some classes (doc), from the texts of their smallest ids; equal rows may give a set twice."""
        some = common.written(docs.join(classes.select(F.col("class").alias("doc"), "hi", "lo", "rep"), "doc"), "some")
        count = some.count()
        ids = common.small(some.select(F.col("rep").alias("m")).distinct(), count, MOST_BROADCAST)
        found = rows.join(ids, F.col("doc") == F.col("m"), "left_semi").mapInArrow(as_sets, "hi long, lo long, set binary")
        out = common.written(found.join(common.small(some.drop("rep"), count, MOST_BROADCAST), ["hi", "lo"]).select("doc", "set"), "whole-sets")
        common.forget(some)
        return out

    def cells(column) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, 1 << CELL_BITS)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_link(cells(batch.column("ka")), cells(batch.column("kb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), num, den) if batch.num_rows else np.empty(0, bool)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def undecided(key: tuple, group: pa.Table) -> pa.Table:
        """Members of a tile that may be similar to one in another component."""
        ids, component, size, k = group.column("doc").to_numpy(), group.column("component").to_numpy(), group.column("size").to_numpy(), cells(group.column("sketch"))
        some = [i for i in range(len(ids)) if (may_link(k[i], k, size[i], size, num, den) & (component != component[i])).any()]
        return pa.table({"first": [key[0].as_py()] * len(some), "doc": ids[some], "component": component[some], "size": size[some]}, schema=pa.schema([("first", pa.int64()), ("doc", pa.int64()), ("component", pa.int64()), ("size", pa.int64())]))

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        ids, component = group.column("doc").to_numpy(), group.column("component").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for c in group.column("set").chunks for s in c]
        a, b = similar(sets, component, num, den)
        root = roots(len(ids), a, b)
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[root[some]], "b": ids[some]})

    def chunked(family: DataFrame, amount: Column, most: int) -> tuple[DataFrame, int]:
        """(first, main, rows, columns) of families in more than one component: their largest one, and the chunks of its
        others and of all, by the amounts of their members; and how many they are."""
        each = family.groupBy("first", "component").agg(F.sum(amount).alias("n"))
        whole = each.groupBy("first").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main")).where("k > 1")
        chunks = common.written(whole.select("first", F.col("main.component").alias("main"), *(F.ceil(n / most).cast("int").alias(c) for n, c in ((F.col("all") - F.col("main.n"), "rows"), (F.col("all"), "columns")))), "chunks")
        return chunks, chunks.count()

    def brought_down(family: DataFrame, amount: Column, most: int) -> DataFrame:
        """The families, those of very many tiles brought down to sets that share a rare element."""
        chunks, n_chunks = chunked(family, amount, most)
        large = chunks.where(F.col("rows") * F.col("columns") > MOST_TILES).select("first")
        if not large.isEmpty():
            some = common.small(large, n_chunks, MOST_BROADCAST)
            finer = refined(family.join(some, "first", "left_semi"))
            before, family = family, common.written(family.join(some, "first", "left_anti").unionByName(finer), "families")
            common.forget(before, finer)
        common.forget(chunks)
        return family

    def refined(family: DataFrame) -> DataFrame:
        """(first, doc, component, size): families of those members of a family that share an element of their prefixes.

        A prefix has the elements of a set that are rarest in the family, of equal ones the smallest, as many as two sets
        can't do without and be similar enough: |s| - ceil(|s| num / den) + 1. So no pair is lost, and what all members
        have in common brings none of them together. Elements are counted before they are joined; those that very many
        members have are joined by a broadcast. Members of one component needn't meet, and of families with the same
        members one stays.
        """

        def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc, s in zip(batch.column("doc").to_pylist(), batch.column("set"), strict=True):
                    e = np.frombuffer(s.as_buffer(), np.int64)
                    yield pa.record_batch([pa.array(np.full(len(e), doc)), pa.array(e)], names=["doc", "e"])

        sets_of = whole(family.select("doc").distinct())
        each = common.written(family.join(sets_of.dropDuplicates(["doc"]).mapInArrow(elements, "doc long, e long"), "doc"), "elements")
        counts = common.written(each.groupBy("first", "e").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")), "element-counts")
        told = common.join_groups(each, counts, ["first", "e"], "n", each.count())
        place = F.row_number().over(Window.partitionBy("first", "doc").orderBy("n", "e"))
        prefix = F.col("size") - F.floor((F.col("size") * num + den - 1) / den) + 1
        shared = told.withColumn("place", place).where((F.col("place") <= prefix) & (F.col("low") < F.col("high")))
        found = common.written(shared.select(F.xxhash64("first", "e").alias("first"), "doc", "component", "size").distinct(), "families")
        members = [F.bit_xor(F.xxhash64("doc", F.lit(k))).alias(f"m{k}") for k in (0, 1)]
        alike = found.groupBy("first").agg(F.count("*").alias("n"), *members).groupBy("n", "m0", "m1").agg(F.min("first").alias("first")).where("n > 1")
        out = common.written(found.join(alike.select("first"), "first", "left_semi"), "families")
        common.forget(sets_of, each, counts, found)
        return out

    def tiles(family: DataFrame, amount: Column, most: int) -> DataFrame:
        """(first, i, j, doc, component, size): families in more than one component, dealt out in tiles. The largest
        component's members needn't meet each other: chunks of the others meet chunks of all."""
        chunks, n = chunked(family, amount, most)
        chunks = common.small(chunks, n, MOST_BROADCAST)
        at = lambda c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")
        dealt = family.join(chunks, "first").withColumns({"i": at("rows"), "j": at("columns")})
        across = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
        along = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
        places = F.when(F.col("component") == F.col("main"), across).otherwise(F.array_union(across, along))
        return dealt.select("first", F.explode(places).alias("at"), "doc", "component", "size").select("first", "at.i", "at.j", "doc", "component", "size")

    one = F.lit(1)
    # an id that repeats with other texts ties their classes
    repeated = copies.groupBy("doc").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("doc", "a")
    links = copies.join(repeated, "doc").select("a", F.col("class").alias("b")).where("a <> b").distinct()
    sketches = classes.select(F.col("class").alias("doc"), F.col("size").alias("n"), "sketch")
    # each class with the first one of most of its buckets: that ties most of a group of near copies together
    met = buckets.groupBy("first", "doc").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    met = common.written(met, "met")
    common.forget(buckets)
    pairs = met.where("doc <> first").groupBy(F.col("doc").alias("b")).agg(F.max(F.struct("n", "first"))["first"].alias("a"))
    told = pairs.join(sketches.toDF("a", "na", "ka"), "a").join(sketches.toDF("b", "nb", "kb"), "b")
    pairs = common.written(told.mapInArrow(possible, "a long, b long").distinct(), "pairs")
    own = whole(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    links = common.written(links.union(both.mapInArrow(compared, "a long, b long")), "links")
    common.forget(own, pairs)
    known = common.components(links, "near")
    member = known.select(F.col("node").alias("doc"), "component")
    # then whatever shares a bucket and is still apart: buckets with the same first class make a family. Sketches
    # show which members can't be similar to any in another component; the rest are compared in tiles of bounded size,
    # which return a forest of their links
    family = met.join(member, "doc", "left").select("first", "doc", F.coalesce("component", "doc").alias("component"), "size")
    family = common.written(family, "families")
    common.forget(met, known)
    family = brought_down(family, one, SKETCHES)
    dealt = tiles(family, one, SKETCHES).join(sketches.select("doc", "sketch"), "doc")
    rest = common.written(dealt.groupBy("first", "i", "j").applyInArrow(undecided, "first long, doc long, component long, size long").distinct(), "undecided")
    common.forget(family)
    rest = brought_down(rest, F.col("size"), TILE)
    own = whole(rest.select("doc").distinct())
    more = tiles(rest, F.col("size"), TILE).join(own, "doc").groupBy("first", "i", "j").applyInArrow(joined, "a long, b long")
    all_links = common.written(links.union(more), "links")
    common.forget(links, rest, own)
    known = common.components(all_links, "near")
    member = known.select(F.col("node").alias("class"), "component")
    # a component of classes has the smallest id of any of its documents
    told = classes.join(member, "class", "left").select("class", "rep", "copies", F.coalesce("component", "class").alias("group"))
    least = told.groupBy("group").agg(F.min("rep").alias("component"))
    told = common.written(told.join(least, "group").select("class", "copies", "component"), "told")
    common.forget(all_links, known, classes)
    found = common.join_groups(copies, told, ["class"], "copies", n_rows).groupBy("doc").agg(F.min("component").alias("component"))
    out = sets.select("doc", "n_shingles").join(found, "doc", "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))
    return out, [sets, copies, told]


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component: the one with the smallest id. Documents without words or without an id all stay.

    Of rows with the same id and the same text, one stays; different texts of the id that stays all do. All columns are
    kept, whatever their names; an empty table gives an empty table. Up to MOST_BROADCAST ids that go are broadcast, so
    the texts stay where they are.
    """
    components, steps = _components(docs, n, num, den, ratio=1.4)
    found = common.written(components.where("n_shingles > 0 and doc is not null"), "found")
    common.forget(*steps)
    gone = common.written(found.where("doc <> component").select("doc").distinct(), "gone")
    gone = common.small(gone, gone.count(), MOST_BROADCAST)
    left = docs.join(gone, docs["doc_id"] == gone["doc"], "left_anti")
    again = common.written(found.where("doc = component").groupBy("doc").count().where("count > 1").select("doc"), "again")
    common.forget(found)
    if not (n_again := again.count()):
        return left
    again = common.small(again, n_again, MOST_BROADCAST)
    words = F.coalesce(docs["text"].cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    several = left.join(again, docs["doc_id"] == again["doc"], "left_semi")
    once = several.where(words).dropDuplicates(["doc_id", "text"])
    return left.join(again, docs["doc_id"] == again["doc"], "left_anti").unionByName(several.where(~words)).unionByName(once)


QUERIES = {"op3_jaccard": op3_jaccard}
ORACLES: dict[str, str] = {
    "op3_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""
}
