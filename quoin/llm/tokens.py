"""Token counts of texts in a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quoin.session import spread


def default_vocabulary() -> str:
    """Place of the byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoding of a rank file; built once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = batch.column("text").to_pylist()
            total, head = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                if t:
                    total[i] = len(encode(t))
                    line, found, _ = t.partition("\n")
                    head[i] = min(total[i], len(encode(line + "\n"))) if found else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(head)], names=["key", "tokens", "prompt_tokens"])

    return task


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``key``, tokens and prompt_tokens (those of the first of several lines) of each row; null and empty texts have none. ``vocabulary``:
    path of a rank file, readable on every executor; special tokens in a text are ordinary text."""
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    schema = StructType([StructField("key", df.schema[key].dataType), StructField("tokens", LongType()), StructField("prompt_tokens", LongType())])
    return rows.mapInArrow(_count(vocabulary or default_vocabulary()), schema).withColumnRenamed("key", key)
