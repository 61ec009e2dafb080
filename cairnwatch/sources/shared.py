"""The folder that driver and executors share, for tables, models and streams' progress."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each local application that names none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder's path below spark.checkpoint.dir; below one of our own where that is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cairnwatch-")
        root = _OWN[app]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch: texts are long, and a batch stands in Python with all that is made of it.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS rows in this session, unless it has a lower bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows that a task of a wide shuffle gets, about.
TASK_ROWS = 1_000_000


def parts_for(spark: SparkSession, rows: float, each: int = TASK_ROWS) -> int:
    """Partitions for so many rows; never fewer than the session deals out by itself.

    A number that is named keeps AQE from merging partitions by their compressed bytes, which
    say little where few bytes become many rows.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def cut(df: DataFrame, tag: str = "cut", group_bytes: int | None = None) -> DataFrame:
    """df as a written table of the shared folder: its plan ends there, and lost executors don't matter to it; row groups of so many bytes, if given."""
    path = shared_folder(df.sparkSession, tag)
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
