"""Queries on drifting, nested, dangling and broken records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castellan.operators import drift, nested, orphans, rejects
from castellan.operators.tables import cut
from castellan.plans.load import table


def _sightings(spark: SparkSession, d: str) -> tuple[dict[str, str], DataFrame]:
    aliases = drift.alias_table(table(spark, d, "field_names"))
    return aliases, drift.field_sightings(table(spark, d, "drift_records"), aliases)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    _, seen = _sightings(spark, d)
    # the catalogue is small next to the records and read four times
    return drift.changes(cut(drift.lifespans(cut(seen))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("file_id", "field_path", "change_kind")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


def p2_casts(spark: SparkSession, d: str) -> DataFrame:
    return drift.casts(_sightings(spark, d)[1]).drop("plain_lists", "in_lists")


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    aliases, seen = _sightings(spark, d)
    return drift.consistent_table(table(spark, d, "drift_records"), aliases, *drift.table_plan(cut(drift.casts(seen))))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Filled cells of every column of p2_table."""
    aliases, seen = _sightings(spark, d)
    return drift.values_per_path(table(spark, d, "drift_records"), aliases, drift.table_plan(cut(drift.casts(seen)))[0])


def _nodes(spark: SparkSession, d: str, with_members: bool = True) -> DataFrame:
    return nested.node_table(table(spark, d, "nested_records"), with_members)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, False).where("kind <> 'record' and parent_pre is not null").select("rec_id", "node_path", "node_type", "link_key")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.record_table(_nodes(spark, d))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    return nested.block_table(_nodes(spark, d))


def p3_parts(spark: SparkSession, d: str) -> DataFrame:
    return nested.part_table(_nodes(spark, d))


def p3_hunks(spark: SparkSession, d: str) -> DataFrame:
    return nested.hunk_table(_nodes(spark, d))


def p3_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return nested.unreadable(table(spark, d, "nested_records"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*orphans.references(*(table(spark, d, t) for t in ("session_messages", "tool_results", "findings", "session_files", "call_deletions"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_column", "ref_key")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_orphans(spark, d))


def _judged(spark: SparkSession, d: str, with_text: bool = False, with_fields: bool = False) -> DataFrame:
    return rejects.verdicts(table(spark, d, "raw_lines"), with_text, with_fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failures(_judged(spark, d)).select("raw_id", "reason")


def p5_failures(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failures(_judged(spark, d, with_text=True))


def p5_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return rejects.csv_rows(_judged(spark, d, with_fields=True))


def p5_jsonl_rows(spark: SparkSession, d: str) -> DataFrame:
    return rejects.jsonl_rows(_judged(spark, d, with_fields=True))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Failing lines per file and reason."""
    return rejects.failures(_judged(spark, d)).groupBy("src_file", "line_format", "reason").agg(F.count(F.lit(1)).alias("failing"))


QUERIES = {f.__name__: f for f in (p2_found, p2_changes, p2_casts, p2_table, p2_values, p3_found, p3_records, p3_blocks, p3_parts, p3_hunks, p3_unreadable, p4_found, p4_report, p5_found, p5_failures, p5_csv_rows, p5_jsonl_rows, p5_report)}
