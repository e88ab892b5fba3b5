"""Intermediates written to the shared checkpoint folder.

A written table survives lost executors, cuts lineage, and fixes rows whose content
depends on a physical layout.  The folder is the one the cluster names in
``spark.checkpoint.dir``; a session on one machine that has none (a test) gets one in its
warehouse folder.  What this process has written is deleted by ``cleanup``, once no result
is read any more.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/checkpoints-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/tabscope/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediates this process has written, and say how many; results read from them end with them."""
    jvm = spark.sparkContext._jvm
    n = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back; ``by``: in a folder for each value of a column of few, read alone where only that is asked for."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixed(df: DataFrame) -> DataFrame:
    """Hold a result table of a few rows (per column, pair or signal) on the driver.

    For metric tables only: their size depends on the number of columns, never of rows.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def together(**steps: Callable[[], object]) -> dict[str, object]:
    """Results by name of independent steps, whose Spark jobs run side by side."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        started = {name: pool.submit(step) for name, step in steps.items()}
        return {name: step.result() for name, step in started.items()}
