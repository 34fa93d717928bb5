"""A local session for tests, checks and the benchmark."""

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabframe")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.environ.get("SPARK_WAREHOUSE", "/tmp/tabframe-warehouse"))
    )
    for item in filter(None, os.environ.get("TABFRAME_CONF", "").split(",")):
        name, _, value = item.partition("=")
        builder = builder.config(f"spark.tabframe.{name}", value)
    return builder.getOrCreate()
