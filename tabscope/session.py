"""A local session for tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", checkpoints: str | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tabscope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # recording the Python line of every column expression costs more than planning it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # one machine only, so its own folder is the shared one
        .config("spark.checkpoint.dir", checkpoints or tempfile.mkdtemp(prefix="tabscope-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
