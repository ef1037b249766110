"""Auditing sessions as they end.

A finished transcript is a new file in a folder; each micro-batch of new files is audited
and one history line per session is appended.  A file is read once: the stream's
checkpoint holds which files were seen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from castellan.operators import grading
from castellan.operators.tables import cut, stored
from castellan.plans.audit import audit_events
from castellan.sources import history, transcripts


#: Files of one micro-batch.
FILES_PER_BATCH = 1000


def ended_files(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream of (path, split, line) of finished transcripts: the lines of each file, with
    the start of the split they lie in."""
    read = spark.readStream.format("text").option("lineSep", "\n").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return transcripts.split_lines(read)


def audit_ended(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = False, files_per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """Audits every new file; ``sink`` gets (session_key, line, ...) of each micro-batch.

    A batch holds whole files, at most ``files_per_batch``, and is audited as it comes.
    Results depend on one file only, so there is no state between batches.  A batch may be
    repeated after a failure: a sink should be idempotent by its batch id.
    """

    def each(batch: DataFrame, number: int) -> None:
        events = stored(transcripts.events(transcripts.numbered_lines(cut(batch))))
        done = audit_events(events)
        sink(grading.summary_lines(done.results), number)

    writer = ended_files(spark, folder, files_per_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_history(path: str, reason: str = "ended") -> Callable[[DataFrame, int], None]:
    """Sink that appends to the text log, in order of the sessions' keys."""

    def append(lines: DataFrame, number: int) -> None:
        now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        for r in lines.orderBy("session_key").select("line").toLocalIterator():
            history.append(path, history.entry_line(now, reason, r.line))

    return append


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes each batch into its own folder, so a repeated batch replaces itself."""
    return lambda lines, number: lines.withColumn("audited_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")
