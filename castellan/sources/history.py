"""History log: one line per ended session, appended; read newest first."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castellan.sources.transcripts import numbered_lines, split_lines


def default_log() -> str:
    return os.environ.get("CASTELLAN_HISTORY_LOG") or os.path.join(os.path.expanduser("~"), ".castellan", "history.log")


def newest_first(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(seq, entry) of the lines that aren't blank, newest first; a positive limit keeps so
    many.  ``seq`` numbers the lines of the file; a line may hold several entries, parted
    by other signs that end lines.  The log is read in splits."""
    lines = numbered_lines(split_lines(spark.read.option("lineSep", "\n").text(path)))
    parts = F.posexplode(F.split(F.expr("make_valid_utf8(cast(line as string))"), "[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))
    rows = lines.select("event_index", parts.alias("part", "entry")).where(F.length(F.trim("entry")) > 0)
    rows = rows.orderBy(F.desc("event_index"), F.desc("part")).select(F.col("event_index").alias("seq"), "entry")
    return rows.limit(limit) if limit > 0 else rows


def entry_line(when: str, reason: str, summary: str) -> str:
    return f"[{when}] reason={reason or 'unknown'}  {summary}\n"


def append(path: str, line: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(line)
