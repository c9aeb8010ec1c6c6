"""Session construction with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Wall-clock zone in which publishers' days are counted.
LOCAL_TZ = "Asia/Taipei"


def get_spark(app: str = "pressgauge", cores: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the submitted one."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
