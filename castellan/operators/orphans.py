"""References whose target does not exist.

Parent keys and child references are tagged and unioned in long form, then grouped by
parent table and key.  Only what a group needs travels: parents and deletions are reduced
to two timestamps, children to one row per distinct key.  Groups without a living parent
are the orphan keys; child rows are matched to them with a join that may split hot keys,
so no group of children is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castellan.functions.text import not_blank, session_key, trim_blanks
from castellan.operators.messages import is_call, kept_rows, role
from castellan.operators.tables import cut

CALLS, SESSIONS = "calls", "sessions"


def references(messages: DataFrame, results: DataFrame, findings: DataFrame, files: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, children) in long form.

    parents: target, key_session, key_id, alive_at (of a call), deleted_at (of a deletion).
    children: ref_table, ref_column, ref_key, target, key_session, key_id, at.
    Blank references are no references; a row without a session key refers to nothing
    that exists.
    """
    # parents and children come from the same rows, and children are read twice: written once
    kept = cut(kept_rows(
        messages.withColumn("_role", role()),
        F.when(is_call(F.col("_role")), trim_blanks(F.col("content_id"))).alias("call"),
        F.nullif(trim_blanks(F.col("tool_use_id")), F.lit("")).alias("ref"),
    ).where("call is not null or ref is not null").drop("src_path", "line_no", "_block"))
    none = F.lit(None).cast("string")
    never = F.lit(None).cast("timestamp")
    parents = (
        kept.where("call is not null").select(F.lit(CALLS).alias("target"), F.col("session_key").alias("key_session"), F.col("call").alias("key_id"), F.col("ingest_ts").alias("alive_at"), never.alias("deleted_at"))
        .unionByName(deletions.select(F.lit(CALLS).alias("target"), session_key(F.col("session_id")).alias("key_session"), trim_blanks(F.col("content_id")).alias("key_id"), never.alias("alive_at"), "deleted_at"))
        .unionByName(files.select(F.lit(SESSIONS).alias("target"), session_key(F.col("session_id"), F.col("src_path")).alias("key_session"), F.lit("").alias("key_id"), F.lit("1970-01-01").cast("timestamp").alias("alive_at"), never.alias("deleted_at")))
    )

    def child(df: DataFrame, table: str, column: str, key: str, target: str, session, ref, at: str) -> DataFrame:
        return df.where(not_blank(F.col(column))).select(
            F.lit(table).alias("ref_table"), F.lit(column).alias("ref_column"), F.col(key).cast("long").alias("ref_key"), F.lit(target).alias("target"),
            session.alias("key_session"), ref.alias("key_id"), F.col(at).alias("at"),
        )

    own = session_key(F.col("session_id"))
    children = (
        kept.where("ref is not null").select(F.lit("session_messages").alias("ref_table"), F.lit("tool_use_id").alias("ref_column"), F.col("row_id").cast("long").alias("ref_key"), F.lit(CALLS).alias("target"), F.col("session_key").alias("key_session"), F.col("ref").alias("key_id"), F.col("ingest_ts").alias("at"))
        .unionByName(child(results, "tool_results", "tool_use_id", "result_id", CALLS, own, trim_blanks(F.col("tool_use_id")), "returned_at"))
        .unionByName(child(findings, "findings", "call_id", "finding_id", CALLS, own, trim_blanks(F.col("call_id")), "seen_at"))
        .unionByName(child(findings, "findings", "session_id", "finding_id", SESSIONS, own, F.lit(""), "seen_at"))
    )
    return parents, children


def orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Child rows without a living parent.  A call lives if one of its rows is not older
    than every deletion of its key; equal times leave it alive."""
    key = ["target", "key_session", "key_id"]
    tagged = parents.withColumn("_child", F.lit(0)).unionByName(
        children.select(*key, F.lit(None).cast("timestamp").alias("alive_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(1).alias("_child"))
    )
    lost = (
        tagged.groupBy(*key)
        .agg(F.max("alive_at").alias("_alive"), F.max("deleted_at").alias("_deleted"), F.max("_child").alias("_child"))
        .where("_child = 1 and (_alive is null or _deleted > _alive)")
        .select(*(F.col(k).alias("_" + k) for k in key))
    )
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col("_" + k))
    return children.join(lost, same, "left_semi")


def report(orphan_rows: DataFrame) -> DataFrame:
    """Orphans per table, column and month; a null time counts in a null month."""
    return orphan_rows.groupBy("ref_table", "ref_column", F.date_trunc("month", "at").alias("month")).agg(
        F.count(F.lit(1)).alias("orphans"), F.count_distinct("key_session", "key_id").alias("missing_keys")
    )
