"""Tables written between the rounds of a loop, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is set and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meridia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df written and read again: its plan is a scan from then on, and no round runs twice."""
    path = f"{shared_dir(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of a spread table has at most, and at least where cores are left.
MOST_ROWS, LEAST_ROWS = 20_000, 500


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt to."""
    return max(min(3 * spark.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // MOST_ROWS), 1)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by key: a small file or shuffle is one task or few, whatever the work on its rows is."""
    return df.repartition(tasks(df.sparkSession, df.count()), key)
