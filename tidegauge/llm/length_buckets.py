"""Documents cut into pieces of a power of two of tokens, so that no sequence crosses documents and none needs padding.

A document's number of ids in binary says its pieces: as many full ones as fit, then one for each bit that is left, from the
largest down. A piece is a sequence. Sequences of one length form a bucket; a batch has sequences of one bucket only, always
with the same number of tokens, so that short documents train beside short ones and no attention reaches another document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import text_tokens
from tidegauge.llm.common import batched, rows_of

_FIELDS = (
    ("id", pa.int64(), "long"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long"), ("doc_tokens", pa.int64(), "long"), ("bucket", pa.int32(), "int"),
    ("sequence_id", pa.int64(), "long"), ("batch_id", pa.int64(), "long"), ("offset", pa.int64(), "long"), ("ids", pa.list_(pa.int32()), "array<int>"),
)


def binary_pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n ids: powers of two that don't grow, `size` (itself one) at most."""
    start = 0
    while n - start >= size:
        yield start, size
        start += size
    left = n - start
    while left:
        length = 1 << (left.bit_length() - 1)
        yield start, length
        start += length
        left -= length


def _numbered(bucket: int, task: int, count: int) -> int:
    """Numbers sort by bucket, then task, then count; no two tasks share one."""
    return bucket << 56 | task << 34 | count


def _pieces(path: str, end_id: int, size: int, batch_tokens: int, with_ids: bool):
    fields = _FIELDS if with_ids else _FIELDS[:-1]
    schema = pa.schema([(name, kind) for name, kind, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = text_tokens(path), TaskContext.get().partitionId(), [0] * size.bit_length()

        def rows() -> Iterator[tuple]:
            for name, text in rows_of(batches, "id", "text"):
                ids = np.append(encoder.encode(text or ""), np.array([end_id], "<u4"))
                for start, length in binary_pieces(len(ids), size):
                    bucket, own = length.bit_length() - 1, ids[start : start + length]
                    number = seen[bucket]
                    seen[bucket] += 1
                    placed = (name, start, length, zlib.crc32(own), len(ids), bucket, _numbered(bucket, task, number), _numbered(bucket, task, number * length // batch_tokens), 0)
                    yield (*placed, own.astype(np.int32)) if with_ids else placed

        yield from batched(rows(), schema, 512 if with_ids else 4096)

    return run, ", ".join(f"{name} {kind}" for name, _, kind in fields)


def _decomposed(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, batch_tokens: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    if size & (size - 1) or batch_tokens % size:
        raise ValueError("size must be a power of two, and batch_tokens a multiple of it")
    run, ddl = _pieces(tokenizer_path, end_id, size, batch_tokens, with_ids)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def decompose_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, batch_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document stands: id_col, start, length, ids_crc32, doc_tokens, bucket, sequence_id, batch_id, offset.

    A document is its text's ids and then end_id, doc_tokens together; null and empty texts are the end id alone. Each id
    lies in one piece; a piece fills a sequence of its own, so that offset is 0 and padding none. bucket is the length's
    binary logarithm. A batch holds sequences of one bucket, batch_tokens tokens together but for the last one of a task
    in each bucket. sequence_id and batch_id sort by bucket; no two sequences or batches share one, and a task that runs
    again gives the same ones. Rows that repeat an id are documents of their own; null ids stay null. Other columns aren't
    read. An empty table gives an empty result. One pass over the documents without a shuffle; a task holds one of them.
    """
    return _decomposed(docs, tokenizer_path, end_id, size, batch_tokens, id_col, text_col, False)


def bucketed_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, batch_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: the columns of decompose_documents, and ids."""
    return _decomposed(docs, tokenizer_path, end_id, size, batch_tokens, id_col, text_col, True)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Write the sequences as Parquet, a folder for each bucket, so that a reader takes the mixture of lengths that it wants."""
    sequences.write.partitionBy("bucket").parquet(path)
