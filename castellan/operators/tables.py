"""Cutting lineage into the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process, removed when it ends.
_OWN: set[str] = set()


def _clean() -> None:
    try:
        spark = SparkSession.getActiveSession()
        for folder in _OWN if spark is not None else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the engine may be gone already; nothing depends on this
        return


atexit.register(_clean)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the cluster's ``spark.checkpoint.dir``; a temporary
    one only where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="castellan-"))
        _OWN.add(sc._jsc.sc().getCheckpointDir().get())
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; partitions keep their rows and order."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as a table, for readers that want some of its
    columns or rows each.  Order and partitions aren't kept."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    _OWN.add(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
