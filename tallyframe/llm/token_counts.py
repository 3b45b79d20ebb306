"""Operator 5: token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import load_codec, text_batches


def token_count(text: Column, tokenizer: str, batch_bytes: int = 1 << 23) -> Column:
    """Number of tokens of a text column: an Arrow function that takes batches balanced by bytes and returns lengths only.

    Null counts as the empty text. `tokenizer` is the path of a .json (tokenizers) or .model (sentencepiece) file that
    every executor has. Texts are cut at boundaries that no token crosses (see tokens.py), never shortened.
    """

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = load_codec(tokenizer)
        for batch in batches:
            found = [codec.counts(texts) for _, _, texts in text_batches(batch, batch_bytes)]
            yield pa.array(np.concatenate(found) if found else [], pa.int64())

    return counts(text)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null text: 0 bytes and no tokens. Very long texts are counted whole, in parts. Repeated rows stay repeated, and equal
    texts (ties) have equal counts; a text of exactly `limit` tokens isn't over it. An input column named like a result
    column is replaced by it; all others stay. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_count(text, tokenizer)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
