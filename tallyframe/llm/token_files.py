"""Operator 2: token ids in files of Simple-8b words.

A 64-bit word holds a selector in its top 4 bits and as many ids as fit its 60 data bits at that selector's width, the
first id lowest. Selector 0 is a run of 240 zeros; selector 1 is an escape: the next word is one raw 64-bit id; 2 to 15
are the (count, bits) of SELECTORS. Ids are coded in lanes of LANE ids, each starting at a word of its own, and a block
says where each lane starts, so that all lanes of a block are coded and decoded side by side by numpy.

A block, little-endian: b"S8B1", then unsigned 32-bit n_docs, n_ids, n_words and a flag that is 1 if there are
escapes; then int64 doc_id[n_docs], uint8 has_id[n_docs], uint32 n_tokens[n_docs], uint32 first_word[n_lanes + 1] and
uint64 word[n_words]. A file is a Parquet file with a row for each block: part and block say its place, ids_before the
ids of the same part before it. Parts and blocks in order hold the documents in ascending order. Spark's own writer
commits the files, so a lost task leaves no half-written block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import load_codec, text_batches

#: (count, bits) of selectors 0 to 15; (1, 64) is the escape.
SELECTORS = ((240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
LANE = 256
ESCAPE = 1
_COUNT = np.array([n for n, _ in SELECTORS])
_HEAD = struct.Struct("<4sIIII")


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each lane and the number of words) of ids (unsigned 64-bit)."""
    lanes = -(-len(ids) // LANE)
    if not lanes:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    grid = np.zeros((lanes, LANE + 240), np.uint64)  # a lane's last words read zeros behind it
    grid[: lanes - 1, :LANE] = ids[: LANE * (lanes - 1)].reshape(-1, LANE)
    grid[-1, : len(ids) - LANE * (lanes - 1)] = ids[LANE * (lanes - 1) :]
    sizes = np.full(lanes, LANE)
    sizes[-1] = len(ids) - LANE * (lanes - 1)
    best = _best_selectors(grid)
    at, rows = np.zeros(lanes, np.int64), np.arange(lanes)
    found = []
    while len(rows):
        chosen = best[rows, at[rows]]
        found.append((rows, at[rows], chosen))
        at[rows] += _COUNT[chosen]
        rows = rows[at[rows] < sizes[rows]]
    lane, place, chosen = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(lane, kind="stable")
    lane, place, chosen = lane[order], place[order], chosen[order]
    takes = 1 + (chosen == ESCAPE)
    first = np.cumsum(takes) - takes
    words = np.empty(int(takes.sum()), np.uint64)
    for s in np.unique(chosen):
        n, bits = SELECTORS[s]
        at_s = np.flatnonzero(chosen == s)
        word = np.full(len(at_s), int(s) << 60, np.uint64)
        if s == ESCAPE:
            words[first[at_s] + 1] = grid[lane[at_s], place[at_s]]
        elif bits:
            for k in range(n):
                word |= grid[lane[at_s], place[at_s] + k] << np.uint64(bits * k)
        words[first[at_s]] = word
    ends = np.cumsum(np.bincount(lane, takes, lanes)).astype(np.uint32)
    return words, np.concatenate([np.zeros(1, np.uint32), ends])


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits of each number (unsigned 64-bit); 0 has none."""
    low = np.frexp((values & np.uint64((1 << 32) - 1)).astype(np.float64))[1]
    high = np.frexp((values >> np.uint64(32)).astype(np.float64))[1] if values.max(initial=0) >> 32 else 0
    return np.where(high, high + 32, low).astype(np.uint8)


def _best_selectors(grid: np.ndarray) -> np.ndarray:
    """For each lane and place, the selector that packs most of the following ids."""
    best = np.full((len(grid), LANE), ESCAPE, np.int8)
    wide = {1: bit_widths(grid)}  # the most bits of each n ids in a row, from those of fewer
    for s in range(15, -1, -1):
        n, bits = SELECTORS[s]
        if s == ESCAPE:
            continue
        half = 1
        while half < n:
            step = min(half, n - half)
            if half + step not in wide:
                wide[half + step] = np.maximum(wide[half][:, :-step], wide[half][:, step:])
            half += step
        fits = wide[n][:, :LANE] <= bits
        if fits.all():
            best[:] = s
        else:
            best[fits] = s
    return best


def decode_ids(words: np.ndarray, starts: np.ndarray, n_ids: int, escapes: bool = True) -> np.ndarray:
    """The ids (unsigned 64-bit) of encode_ids."""
    lanes = len(starts) - 1
    out = np.zeros((lanes, LANE + 240), np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    lane = np.repeat(np.arange(lanes), np.diff(starts.astype(np.int64)))
    raw = np.zeros(len(words), bool)
    if escapes:  # a word behind an escape is raw: walk all lanes at once
        at, end = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
        while (live := at < end).any():
            now = at[live]
            esc = selector[now] == ESCAPE
            raw[now[esc] + 1] = True
            at[live] += 1 + esc
    counts = np.where(raw, 0, _COUNT[selector])
    total = np.cumsum(counts) - counts
    place = total - total[starts[:-1].astype(np.int64)][lane] if len(words) else total
    for s in np.unique(selector[~raw]):
        n, bits = SELECTORS[s]
        at = np.flatnonzero((selector == s) & ~raw)
        if s == ESCAPE:
            out[lane[at], place[at]] = words[at + 1]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for k in range(n):
                out[lane[at], place[at] + k] = (words[at] >> np.uint64(bits * k)) & mask
    return out[:, :LANE].reshape(-1)[:n_ids]


def encode_block(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint64)
    words, starts = encode_ids(ids)
    escapes = int(len(ids) > 0 and int(ids.max()) >> 60 > 0)
    has = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    names = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    parts = (_HEAD.pack(b"S8B1", len(doc_ids), len(ids), len(words), escapes), names.astype("<i8").tobytes(), has.tobytes(), counts.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes())
    return b"".join(parts)


def decode_block(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc ids, number of ids of each, all ids) of a block."""
    magic, n_docs, n_ids, n_words, escapes = _HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a block of token ids")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    names, has, counts = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    starts, words = take("<u4", -(-n_ids // LANE) + 1), take("<u8", n_words)
    return pa.array(names, pa.int64(), mask=has == 0), counts, decode_ids(words, starts, n_ids, bool(escapes))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents and their counts, with end_id behind each document's."""
    ends = np.cumsum(counts + 1)
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, counts + 1


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 23) -> None:
    """Write the ids of each text, and end_id behind them, in ascending order of id_col.

    Rows are dealt out by ranges of the id, so no task holds more than its range; within it, texts are encoded by bytes
    and blocks closed at block_ids ids, so very long texts cost the memory of one text. Null text: empty, so end_id
    alone. Null ids come first; rows of one id, ties and repeats alike, follow each other in the order of their texts. A
    document is never in two blocks. Extra columns, whatever their names, are not written. An empty table gives files
    without blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, block, before = load_codec(tokenizer), TaskContext.get().partitionId(), 0, 0
        waiting = (pa.array([], pa.int64()), np.empty(0, np.int64), np.empty(0, np.int32))

        def close(names: pa.Array, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            nonlocal block, before
            row = [[part], [block], [before], [len(ids)], [encode_block(names, counts, ids)]]
            block, before = block + 1, before + len(ids)
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["part", "block", "ids_before", "n_ids", "data"])

        for batch in batches:
            for a, b, texts in text_batches(batch.column(1), batch_bytes):
                ids, counts = with_end(*codec.encode(texts), end_id)
                names = pa.concat_arrays([waiting[0], batch.column(0).slice(a, b - a)])
                counts, ids = np.concatenate([waiting[1], counts]), np.concatenate([waiting[2], ids])
                ends, at, start = np.cumsum(counts), 0, 0
                while ends[-1] - start >= block_ids:
                    last = int(np.searchsorted(ends, start + block_ids))
                    yield close(names.slice(at, last + 1 - at), counts[at : last + 1], ids[start : ends[last]])
                    at, start = last + 1, int(ends[last])
                waiting = (names.slice(at), counts[at:], ids[start:])
        if len(waiting[0]):
            yield close(*waiting)

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, block int, ids_before long, n_ids long, data binary").write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files of write_ids: start is the number of ids before it,
    ids are little-endian unsigned 32-bit integers. Files without blocks give an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, counts, ids = decode_block(data.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = ids.astype("<u4")
                columns = [names, pa.array(before + ends - counts, pa.int64()), pa.array(counts, pa.int64())]
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                values = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.record_batch([*columns, values], names=["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part")
    return placed.select((F.col("base") + F.col("ids_before")).alias("before"), "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_path(spark, "token-ids")
    write_ids(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_simple8b": op2_simple8b}
ORACLES: dict[str, str] = {}
