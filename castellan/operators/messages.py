"""Transcript rows: which delivery counts, what role it has and where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castellan.functions.datetimes import instant_micros
from castellan.functions.text import not_blank, session_key, trim_blanks
from castellan.operators.tables import cut

#: Lines of a file that one fill group holds; files of any length split into such blocks.
BLOCK_LINES = 4096

#: Role spellings (fixed values).
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "system": "system"}


def role() -> Column:
    """user, assistant or system; null for anything else."""
    said = F.lower(trim_blanks(F.when(not_blank(F.col("msg_role")), F.col("msg_role")).otherwise(F.col("event_type"))))
    return F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[said]


def kept_rows(messages: DataFrame, *columns: Column, ties: bool = False) -> DataFrame:
    """One row per session key, src_path and line_no: the latest delivery.

    Greatest ingest_ts wins, then greatest row_id; a null ingest_ts loses to any other.
    Rows that name no session are dropped; null src_path or line_no are values of their
    own.  ``columns`` (aliased) are computed before the shuffle, so only they travel.
    With ``ties``, ``_tied`` says that another row has the same ingest_ts and row_id.
    Distribution is by (session key, file, block of lines): a file or session that holds
    a large share of all rows still spreads over many tasks.
    """
    rows = messages.select(
        session_key(F.col("session_id"), F.col("src_path")).alias("session_key"),
        F.col("src_path"),
        F.col("line_no"),
        F.floor(F.col("line_no") / BLOCK_LINES).cast("int").alias("_block"),
        F.col("row_id"),
        F.col("ingest_ts"),
        *columns,
    ).where("session_key is not null")
    best = Window.partitionBy("session_key", "src_path", "_block", "line_no").orderBy(
        F.col("ingest_ts").desc_nulls_last(), F.col("row_id").desc()
    )
    rows = rows.repartition("session_key", "src_path", "_block")
    if ties:
        next_ = F.lead(F.struct("ingest_ts", "row_id")).over(best)
        rows = rows.withColumn("_tied", F.coalesce(next_.eqNullSafe(F.struct("ingest_ts", "row_id")), F.lit(False)))
    return rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def with_instants(kept: DataFrame, ts: str = "_ts") -> DataFrame:
    """Adds ``instant`` (microseconds): the row's own, else that of the nearest row before
    it in its file that has one; null where there is none.

    ``ts`` is a column of instants made by :func:`instant_of`.  Inside a block of lines a
    running window fills, and the rows are written once, so that the input is read and
    shuffled once.  What a block hands on is one row per block, so no window ever runs over
    all rows of a long file; only rows still without an instant are joined with it.
    """
    block = Window.partitionBy("session_key", "src_path", "_block").orderBy("line_no")
    filled = cut(kept.withColumn("instant", F.last(ts, ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0))).drop(ts))
    ends = filled.groupBy("session_key", "src_path", "_block").agg(F.max_by("instant", "line_no").alias("_last"), F.max(F.col("instant").isNull()).alias("_gap"))
    before = Window.partitionBy("session_key", "src_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        ends.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .where("_gap and _carry is not null")
        .select(F.col("session_key").alias("_k"), F.col("src_path").alias("_p"), F.col("_block").alias("_b"), "_carry")
    )
    same = (F.col("session_key") == F.col("_k")) & F.col("src_path").eqNullSafe(F.col("_p")) & (F.col("_block") == F.col("_b"))
    late = filled.where("instant is null").join(carry, same, "left").withColumn("instant", F.col("_carry"))
    return filled.where("instant is not null").unionByName(late.select(filled.columns))


def instant_of() -> Column:
    return instant_micros(F.col("ts_text")).alias("_ts")


def is_call(role_: Column) -> Column:
    return (role_ == "assistant") & not_blank(F.col("content_id")) & not_blank(F.col("tool_name"))
