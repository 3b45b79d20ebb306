"""Operator 9: best-fit packing of token sequences, bounded-space and online."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_files import with_end
from .tokens import load_codec, text_batches


#: Pieces of a batch of results: at most 16 MB of ids.
PIECES = 4096


class OpenBins:
    """A fixed number of open bins; a bitset has bit f set if some open bin has f places free."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.n_open, self.n_bins = 0, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return got

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the fullest open bin in which it fits, else a new bin."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open == self.most_open:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, at = self.size, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.n_open += 1
        return at, self.size - free


def pieces_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents with these numbers of ids (at least 1): whole pieces
    from the end, so only a document's first may be shorter."""
    n = -(-counts // size)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (counts - (n - 1) * size)[doc]
    return doc, piece, np.where(piece > 0, first + (piece - 1) * size, 0), np.where(piece > 0, size, first)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, most_open: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 23) -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens: doc_id, piece, start, length, ids, sequence_id, offset.

    A document's ids are its text's ids and end_id; ids holds a piece's ids as little-endian unsigned 32-bit integers.
    Each Spark partition fills sequences of its own with `most_open` open bins, taking pieces as they come, so a
    partition leaves at most `most_open` bins unfilled whatever its size, and one batch of texts bounds its memory. Of
    bins with equally little free space (ties), the one that got so last takes the piece. Null and empty texts: a single
    end_id. Very long texts are cut into pieces of `size` ids. Null and repeated ids: each row is a document. Extra
    columns, whatever their names, are not carried. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, bins = load_codec(tokenizer), OpenBins(size, most_open)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, texts in text_batches(batch.column(1), batch_bytes):
                ids, counts = with_end(*codec.encode(texts), end_id)
                doc, piece, start, length = pieces_of(counts, size)
                # a document's pieces follow each other in ids, so every piece is a slice of them
                ends, own = np.cumsum(length), np.ascontiguousarray(ids, "<u4")
                for k in range(0, len(doc), PIECES):
                    some = slice(k, k + PIECES)
                    low = int(ends[k] - length[k])
                    values = own[low : int(ends[some][-1])]
                    offsets = np.concatenate([[0], 4 * (ends[some] - low)]).astype(np.int32)
                    places = np.array([bins.put(n) for n in length[some].tolist()], np.int64)
                    cols = [
                        batch.column(0).slice(a, b - a).take(pa.array(doc[some])),
                        pa.array(piece[some], pa.int32()),
                        pa.array(start[some], pa.int64()),
                        pa.array(length[some], pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(values)]),
                        pa.array(base + places[:, 0]),
                        pa.array(places[:, 1]),
                    ]
                    yield pa.record_batch(cols, names=out_names)

    out_names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
