"""Operator 6: a quality classifier by compression.

Two zstandard dictionaries are trained, on labelled good and on bad text. A text is cut into chunks, each compressed
with either dictionary; the difference of the compressed sizes over their sum says which text it is like. Text that
repeats itself compresses well with any dictionary, so the share of bytes that the good one leaves counts too. A
logistic curve fitted on labelled texts that the dictionaries haven't seen turns both into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


#: Bytes that draw the numbers of a short text towards those of the empty one: little is known of it.
SMOOTH = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    chunk: int = 2048
    level: int = 1


def features(texts: list[str], good: bytes, bad: bytes, chunk: int, level: int) -> np.ndarray:
    """Two numbers for each text: how much better the good dictionary compresses it than the bad one, in -1 to 1, and
    the share of its bytes that the good one leaves, at most 1.5; 0 and 0.5 for the empty text."""
    import zstandard as z

    # Without content size and checksum, the sizes differ by what the dictionaries save alone.
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": level}
    tools = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), **plain) if d else z.ZstdCompressor(**plain) for d in (good, bad)]
    out = np.tile([0.0, 0.5], (len(texts), 1))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        sizes = [0, 0]
        for at in range(0, len(data), chunk):
            part = data[at : at + chunk]
            for k, tool in enumerate(tools):
                sizes[k] += len(tool.compress(part))
        if data:
            out[i] = (sizes[1] - sizes[0]) / (sizes[0] + sizes[1] + 2 * SMOOTH), min(1.5, (sizes[0] + SMOOTH) / (len(data) + 2 * SMOOTH))
    return out


def _design(x: np.ndarray) -> np.ndarray:
    d, left = x.T
    return np.stack([d, left, left * left, d * left, np.ones_like(d)], 1)


def probability(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(weights), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of the logistic curve through 0/1 labels, by Newton's steps on scaled columns."""
    design = _design(x)
    mean, scale = design.mean(0), design.std(0)
    mean[-1], scale[scale == 0] = 0, 1
    design = (design - mean) / scale
    w, keep = np.zeros(design.shape[1]), ridge * np.eye(design.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + keep, design.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w /= scale
    w[-1] -= mean[:-1] @ w[:-1]
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, sample_bytes: int = 8192, dict_bytes: int = 65536, chunk: int = 2048, level: int = 1) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, label), on a bounded sample.

    Of either label, the first per_class ids by a hash among those that documents with text have make the sample; of a
    text longer than sample_bytes characters, a stretch of so many whose place follows from a hash stands for it. Of
    texts that repeat an id, the least counts. Two of three train the dictionaries, the third fits the curve. Null ids,
    null and empty texts, and labels other than 0 and 1 are left out; an id labelled more than once counts with its
    least label. With one class or none, every text gets the class's share, 0.5 without any row, as with an empty table
    of documents or labels. Columns besides doc_id, text and label aren't read.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    there = known.join(docs.where(F.octet_length("text") > 0).select("doc_id"), "doc_id", "left_semi")
    first = [there.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    long = F.greatest(F.length("text") - sample_bytes + 1, F.lit(1))
    part = F.substr("text", (F.pmod(F.xxhash64("doc_id"), long) + 1).cast("int"), F.lit(sample_bytes)).alias("text")
    found = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(first[0].union(first[1])), "doc_id").select("doc_id", "label", part)
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = found.select("text", "label").collect()
    sample = [r for y in (0, 1) for r in rows if r.label == y]
    y = np.array([r.label for r in sample], float)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(b"", b"", (0.0, 0.0, 0.0, 0.0, float(np.log(share / (1 - share)))), chunk, level)
    third = np.arange(len(sample)) % 3 == 0
    dicts = [_dictionary([r.text.encode("utf-8", "replace") for r, t in zip(sample, third, strict=True) if r.label == k and not t], dict_bytes, chunk) for k in (1, 0)]
    held = [r.text for r, t in zip(sample, third, strict=True) if t]
    return Model(*dicts, _logistic(features(held, *dicts, chunk, level), y[third]), chunk, level)


def _dictionary(texts: list[bytes], size: int, chunk: int) -> bytes:
    import zstandard as z

    parts = [t[at : at + chunk] for t in texts for at in range(0, len(t), chunk)]
    try:
        return z.train_dictionary(size, parts).as_bytes()
    except z.ZstdError:  # too few samples to train on: their end is the dictionary
        return b"".join(parts)[-size:]


def quality_score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a text column. Null counts as the empty text, whose score is the curve's at 0."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = features([t or "" for t in batch.to_pylist()], model.good, model.bad, model.chunk, model.level)
            yield pa.array(probability(x, model.weights), pa.float64())

    return score(text)


def held_out(doc: Column) -> Column:
    """Whether crc32 of an id as text, mod 5, is 0. A null id is written as nothing, so it is held out."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the four training folds: those that are not held out."""
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))


def classify(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= least, ties included). Input columns of these names are
    replaced, all others stay. Null and empty texts have one score; very long texts are scored whole, chunk by chunk.
    Repeated rows stay repeated; an empty table gives an empty table."""
    return docs.withColumn("score", quality_score(F.col(text_col).cast("string"), model)).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, training_labels(labels))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones among them, doesn't reject: those with a score of
    at least `least`. All columns are kept as they are, whatever their names. Null and empty texts, repeated rows and empty
    tables are as in `fit` and `classify`."""
    model = fit(docs, training_labels(labels))
    return docs.where(quality_score(docs["text"].cast("string"), model) >= least)


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
