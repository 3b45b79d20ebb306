"""Operator 11: line dedup by two Bloom filters.

Each task hashes its lines and sends, for each slice of the filters, the bits of what it saw once and of what it saw in
two documents or more. A slice's bits are merged one batch after another: a bit that is seen again goes to the second
filter. A line whose bits the second filter holds is suspected of being a repeat; no repeat is missed. Only suspected
lines are shuffled, as digests, to count their documents exactly and to find their first occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of a filter for each line, and bits of a slice and of the largest filter as powers of 2. The second filter is
#: what is broadcast: 64 MB at most. Past that size more lines are suspected, and results stay the same.
BITS_A_LINE, SLICE, MOST_BITS = 16, 23, 29
#: Hashes that a task holds before it sends their bits on.
HELD = 1_000_000
#: Repeated lines that are broadcast, 16 bytes each; beyond that, lists of them are joined to their texts.
MOST_BROADCAST = 1_000_000
#: Rows that are split into lines at a time.
ROWS = 200
_DIGEST = 16


def keys_of(text: bytes) -> list[bytes]:
    """The keys of a text's lines: A-Z in lower case, without [\\x20\\x09-\\x0D] at both ends. That is how bytes lower and
    strip themselves."""
    return [k.strip() for k in text.lower().split(b"\n")]


def counts(key: bytes, min_chars: int) -> bool:
    """Whether a key has min_chars code points."""
    return len(key) >= min_chars and (min_chars <= 1 or sum(b & 0xC0 != 0x80 for b in key) >= min_chars)


def digest(data: bytes) -> bytes:
    """128 bits of SHA-256: what stands for a key or a text in a shuffle."""
    return hashlib.sha256(data).digest()[:_DIGEST]


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, first bit, second bit in the slice) of hashes, for filters of 2^bits bits."""
    width = min(bits, SLICE)
    at = (h >> np.uint64(64 - (bits - width))) if bits > width else np.zeros(len(h), np.uint64)
    mask = np.uint64((1 << width) - 1)
    return at.astype(np.int64), (h & mask).astype(np.uint32), ((h >> np.uint64(29)) & mask).astype(np.uint32)


def sparse(h: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """The sorted bits of hashes by slice."""
    at, one, two = places(h, bits)
    both = np.unique((np.concatenate([at, at]) << SLICE) | np.concatenate([one, two]).astype(np.int64))
    owner = both >> SLICE
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return {int(p[0] >> SLICE): (p & ((1 << SLICE) - 1)).astype(np.uint32) for p in np.split(both, cuts)} if len(both) else {}


def suspected(twice: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the second filter (bytes, low bits first) holds both bits of each hash."""
    at, one, two = places(h, bits)
    base = at << min(bits, SLICE)
    has = lambda p: (twice[p >> 3] >> (p & 7).astype(np.uint8)) & 1
    return (has(base + one) & has(base + two)).astype(bool)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return ((t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column)


def _hashed(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    """The keys of each text and the hashes of all of them, in one row."""
    import xxhash

    keys = [keys_of(t) for t in texts]
    flat = [k for ks in keys for k in ks]
    return keys, np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))


def _filter(rows: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The second filter over all rows (doc, text): what may be in two documents or more. A row counts as a document."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            once, twice = sparse(h, bits), sparse(h[times > 1], bits)
            held.clear()
            return pa.record_batch([pa.array(list(once), pa.int32()), pa.array([p.tobytes() for p in once.values()], pa.binary()), pa.array([twice[s].tobytes() if s in twice else b"" for s in once], pa.binary())], names=["slice", "once", "twice"])

        n = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                keys, h = _hashed(list(_bytes(batch.column(1).slice(start, ROWS))))
                at = 0
                for ks in keys:
                    own = [x for x, k in zip(h[at : at + len(ks)].tolist(), ks, strict=True) if counts(k, min_chars)]
                    at += len(ks)
                    held.append(np.fromiter(set(own), np.uint64))
                    n += len(held[-1])
                if n >= HELD:
                    yield sent()
                    n = 0
        if n:
            yield sent()

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(1 << min(bits, SLICE), bool), np.zeros(1 << min(bits, SLICE), bool)
        for batch in batches:
            for once, twice in zip(batch.column("once"), batch.column("twice"), strict=True):
                new = np.frombuffer(once.as_buffer(), np.uint32)
                second[new[first[new]]] = True
                first[new] = True
                second[np.frombuffer(twice.as_buffer(), np.uint32)] = True
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(second, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    parts = rows.mapInArrow(seen, "slice int, once binary, twice binary").groupBy("slice").applyInArrow(merged, "slice int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (min(bits, SLICE) - 3)
    for r in parts.toLocalIterator():
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _suspects(rows: DataFrame, twice: np.ndarray, bits: int, min_chars: int) -> DataFrame:
    """(doc, whole, key, line) for each suspected key of each row, whole being the digest of its text and line the first
    place of the key in it."""
    told = rows.sparkSession.sparkContext.broadcast(twice)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                texts = list(_bytes(batch.column(1).slice(start, ROWS)))
                docs = batch.column(0).slice(start, ROWS)
                keys, h = _hashed(texts)
                hit = suspected(told.value, h, bits)
                out: list[tuple[int, bytes, bytes, int]] = []
                at = 0
                for i, ks in enumerate(keys):
                    own = np.flatnonzero(hit[at : at + len(ks)])
                    at += len(ks)
                    if len(own):
                        whole, first = digest(texts[i]), {}
                        for line in own.tolist():
                            if counts(ks[line], min_chars):
                                first.setdefault(ks[line], line)
                        out += [(i, whole, digest(k), line) for k, line in first.items()]
                if out:
                    i, whole, key, line = zip(*out, strict=True)
                    yield pa.record_batch([docs.take(pa.array(i, pa.int64())), pa.array(whole, pa.binary()), pa.array(key, pa.binary()), pa.array(line, pa.int32())], names=["doc", "whole", "key", "line"])

    return rows.mapInArrow(found, "doc long, whole binary, key binary, line int")


_KEPT = "text string, n_lines long, n_dropped long"


def _without(text: bytes, keys: list[bytes], gone: set[bytes], own: set[bytes]) -> tuple[bytes, int, int]:
    """(text, lines, dropped lines) without the lines of keys in gone; of those in own the first line stays."""
    lines = text.split(b"\n")
    kept, seen = [], set()
    for line, key in zip(lines, keys, strict=True):
        if key not in gone or (key in own and key not in seen):
            kept.append(line)
        seen.add(key)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _struct(rows: list[tuple[bytes, int, int]]) -> pa.Array:
    text, lines, dropped = zip(*rows, strict=True) if rows else ((), (), ())
    texts = pa.array(text, pa.binary()).cast(pa.string(), safe=False) if rows else pa.array([], pa.string())
    return pa.StructArray.from_arrays([texts, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])


def _by_broadcast(common_keys: DataFrame, twice: np.ndarray, bits: int, doc: Column, text: Column) -> Column:
    """struct(text, n_lines, n_dropped) from all common keys, sorted, on each executor."""
    table = common_keys.select("key", "first.doc", "first.whole").orderBy("key").toArrow()
    fixed = lambda name: np.frombuffer(b"".join(x.as_py() or bytes(_DIGEST) for x in table.column(name)), f"V{_DIGEST}")
    docs = table.column("doc").fill_null(0).to_numpy()
    known = np.asarray(table.column("doc").is_valid())
    # big-endian halves order as the bytes do
    halves = np.frombuffer(fixed("key").tobytes(), ">u8").reshape(-1, 2).astype(np.uint64)
    told = common_keys.sparkSession.sparkContext.broadcast((twice, halves[:, 0].copy(), halves[:, 1].copy(), docs, known, fixed("whole")))

    def look_up(key: bytes, high: np.ndarray, low: np.ndarray) -> int:
        a, b = int.from_bytes(key[:8], "big"), int.from_bytes(key[8:], "big")
        i = int(np.searchsorted(high, np.uint64(a)))
        while i < len(high) and int(high[i]) == a:
            if int(low[i]) == b:
                return i
            i += 1
        return -1

    @F.arrow_udf(_KEPT)
    def kept(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        twice, high, low, docs, known, wholes = told.value
        for ids, column in columns:
            out = []
            for start in range(0, len(column), ROWS):
                texts = list(_bytes(column.slice(start, ROWS)))
                keys, h = _hashed(texts)
                hit = suspected(twice, h, bits) if len(high) else np.zeros(len(h), bool)
                at = 0
                for own_id, text, ks in zip(ids.slice(start, ROWS).to_pylist(), texts, keys, strict=True):
                    gone, own, whole = set(), set(), None
                    for line in np.flatnonzero(hit[at : at + len(ks)]).tolist():
                        if ks[line] not in gone and (i := look_up(digest(ks[line]), high, low)) >= 0:
                            gone.add(ks[line])
                            if (docs[i] == own_id) if known[i] else own_id is None:
                                whole = whole or digest(text)
                                if wholes[i].tobytes() == whole:
                                    own.add(ks[line])
                    at += len(ks)
                    out.append(_without(text, ks, gone, own))
            yield _struct(out)

    return kept(doc, text)


def _by_list(text: Column, gone: Column, own: Column) -> Column:
    """struct(text, n_lines, n_dropped) from the digests of each text's own common keys and of those that stay once."""

    @F.arrow_udf(_KEPT)
    def kept(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lost, staying in columns:
            out = []
            for t, g, o in zip(_bytes(texts), lost.to_pylist(), staying.to_pylist(), strict=True):
                keys = keys_of(t)
                out.append(_without(t, [digest(k) for k in keys] if g else keys, set(g or ()), set(o or ())))
            yield _struct(out)

    return kept(text, gone, own)


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with the text without repeated lines, n_lines (before) and n_dropped.

    Lines are split at \\n; their keys are as in `keys_of`. A key of at least min_chars code points that at least min_docs
    documents hold is common. keep "none" drops all lines of common keys; "first" keeps one: the first line of the
    document with the smallest id (of rows with this id, in the text with the smallest digest).

    Null and empty texts are one empty line and come out empty. Very long texts are read whole. Rows that repeat an id
    are one document, however many hold the key, and equal rows come out equal; rows without an id are one document for
    each text. Extra columns stay, whatever their names, but for n_lines and n_dropped, which are replaced. An empty table
    gives an empty table. Keys are compared by 128 bits of their SHA-256.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    spark = docs.sparkSession
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), text.alias("text"))
    n_lines, n_rows = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1), F.count("*")).first()
    bits = int(min(max(np.ceil(np.log2((n_lines or 0) * BITS_A_LINE + 1)), 10), most_bits))
    twice = _filter(rows, bits, min_chars)
    suspects = common.written(_suspects(rows, twice, bits, min_chars), "suspects")
    # a document counts once for a key, whatever task its rows are in; only then are documents counted
    who = F.when(F.col("doc").isNull(), F.col("whole")).alias("who")
    each = suspects.groupBy("key", "doc", who).agg(F.min("whole").alias("whole"))
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "whole")).alias("first")
    known = common.written(each.groupBy("key").agg(F.count("*").alias("n"), first).where(F.col("n") >= min_docs), "common-lines")
    if keep == "none":
        known = known.withColumn("first", F.struct(F.lit(None).cast("long").alias("doc"), F.lit(b"").alias("whole")))
    if known.count() <= most_broadcast:
        kept = _by_broadcast(known, twice, bits, doc, text)
        common.forget(suspects, known)
        return _told(docs.withColumn("n_lines", kept), text_col)
    # each text's own list of common keys; texts with many copies are joined by a broadcast, as in join_groups
    pairs = suspects.groupBy("whole", "key").agg(F.count("*").alias("copies"))
    mine = pairs.join(known.select("key", F.col("first.doc").alias("d"), F.col("first.whole").alias("w")), "key")
    lists = mine.groupBy("whole").agg(F.collect_list(F.struct("key", "d", (F.col("w") == F.col("whole")).alias("here"))).alias("_gone"), F.max("copies").alias("_copies"))
    lists = common.written(lists, "line-lists").withColumnRenamed("whole", "_whole")
    common.forget(suspects, known)
    hot = F.col("_copies") > max(common.HOT_ROWS, common.HOT_SHARE * n_rows)
    marked = docs.withColumn("_told", F.struct(F.when(F.length(text) > 0, F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2 * _DIGEST))).alias("whole"), doc.alias("doc")))
    on = F.col("_told.whole") == F.col("_whole")
    names = [c for c in docs.columns]
    joined = marked.join(F.broadcast(lists.where(hot)), on, "left")
    rest = joined.where("_whole is null").select(*(marked[c] for c in [*names, "_told"]))
    plain = rest.where("_told.whole is null").withColumn("_gone", F.lit(None).cast(lists.schema["_gone"].dataType))
    by_text = rest.where("_told.whole is not null").join(lists.where(~hot), on, "left")
    whole = joined.where("_whole is not null").select(*names, "_told", "_gone").unionByName(by_text.select(*names, "_told", "_gone")).unionByName(plain.select(*names, "_told", "_gone"))
    gone = F.transform("_gone", lambda x: x["key"])
    own = F.transform(F.filter("_gone", lambda x: x["here"] & x["d"].eqNullSafe(F.col("_told.doc"))), lambda x: x["key"])
    return _told(whole.withColumn("n_lines", _by_list(text, gone, own)).drop("_told", "_gone"), text_col)


def _told(df: DataFrame, text_col: str) -> DataFrame:
    """df with its column n_lines, a struct, dealt out to its three columns."""
    return df.withColumns({text_col: F.col("n_lines.text"), "n_dropped": F.col("n_lines.n_dropped"), "n_lines": F.col("n_lines.n_lines")})


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(docs, min_docs=10, min_chars=1, keep="none")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES: dict[str, str] = {
    "op11_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM s),
k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone ON gone.key = k.key GROUP BY k.r, k.doc_id
"""
}
