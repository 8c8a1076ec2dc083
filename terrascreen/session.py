"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "terrascreen") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "terrascreen-scratch"))
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the scratch folder."""
    return f"{scratch_base(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_base(spark: SparkSession) -> str:
    """This application's scratch folder: below ``spark.checkpoint.dir`` or, where that is unset, below the warehouse.

    Both are folders that the whole cluster shares.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/terrascreen-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this application, once their results have been written or read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
