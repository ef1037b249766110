"""All queries of the core, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from castellan.plans import audits, records, records_sql, worked

QUERIES = audits.QUERIES | worked.QUERIES | records.QUERIES
SQL: dict[str, str] = audits.SQL | worked.SQL | records_sql.SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return audits.fleet_summary(spark, folder)
