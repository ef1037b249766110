"""Token ids and token counts of whole corpora (narrow: no shuffle)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castellan.llm.bpe import DEFAULT_VOCABULARY, SLICE_BYTES, encoder

#: Rows handed on at once, so that a batch of long texts stays small in memory.
ROWS_OUT = 2000


def bounded(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about SLICE_BYTES of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        to = min(to, at + ROWS_OUT)
        yield batch.slice(at, to - at)
        at = to


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of every row; empty and null texts give an empty list.

    Special tokens are neither added nor recognised in the text.  Repeated keys give
    repeated rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for part in bounded(b, 1):
                ids, off = enc.encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    source = df.select(key, F.col(text).alias("_text"))
    return source.mapInArrow(encode, T.StructType([source.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def texts_of_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text) of lists of ids; an empty or null list gives an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    source = df.select(key, F.col(ids).alias("ids"))
    return source.mapInArrow(decode, T.StructType([source.schema[0], T.StructField("text", T.StringType())]))


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` without its text but with its number of tokens; 0 for empty and null texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            off = enc.encode(b.column(b.num_columns - 1), with_ids=False)[1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(off).astype("int64"))], names=[*b.schema.names[:-1], name])

    rest = [c for c in df.columns if c != text]
    source = df.select(*rest, F.col(text).alias("_text"))
    return source.mapInArrow(count, T.StructType([*source.schema.fields[:-1], T.StructField(name, T.LongType())]))
