"""Order-dependent work on keys of any size.

Rows are range-partitioned by (key, order), so one hot key spreads over many tasks.  A
task sees a contiguous run of rows; only its first and last key can reach into another
task.  Whatever must cross that border is emitted once per border, i.e. at most two rows
per partition, and folded afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castellan.operators.tables import cut


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows range-partitioned and sorted by ``order`` (nulls first)."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def counted(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` in order and written once, with the task of each row (``_pid``) and its 0-based
    place among the rows of its key in that task (``_pos``)."""
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_pos", T.LongType())])
    at = df.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            enc = b.column(at).dictionary_encode()
            code = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.r_[True, code[1:] != code[:-1]]
            begin = np.flatnonzero(first)
            pos = np.arange(b.num_rows) - np.repeat(begin, np.diff(np.r_[begin, b.num_rows]))
            head = b.column(at)[0].as_py()
            if n and head == last:
                end = begin[1] if len(begin) > 1 else b.num_rows
                pos[:end] += n
            last, n = b.column(at)[b.num_rows - 1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, pid, "int32")), pa.array(pos.astype("int64"))],
                names=[*b.schema.names, "_pid", "_pos"],
            )

    return cut(in_order(df, key, *order).mapInArrow(count, schema))


def with_numbers(fixed: DataFrame, key: str, name: str = "seq") -> DataFrame:
    """Rows of :func:`counted` with a 0-based number per ``key`` instead of ``_pid`` and ``_pos``.

    Only keys that reach over a border have an offset: at most one a task, so what is
    broadcast is bounded by the number of tasks.
    """
    sizes = fixed.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("_off", F.sum("_n").over(w))
        .where("_off is not null")
        .select(F.col(key).alias("_key"), F.col("_pid").alias("_part"), "_off")
    )
    return (
        fixed.join(F.broadcast(offsets), (F.col("_pid") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")), "left")
        .withColumn(name, F.col("_pos") + F.coalesce("_off", F.lit(0)))
        .drop("_pid", "_pos", "_key", "_part", "_off")
    )


def numbered(df: DataFrame, key: str, *order: str, name: str = "seq") -> DataFrame:
    """Adds a 0-based number per ``key`` in the given order.

    Equals row_number() - 1 over a window, but a key with a third of all rows does not
    land in one task.  Ties in ``order`` get any order; make it unique.
    """
    return with_numbers(counted(df, key, *order), key, name)
