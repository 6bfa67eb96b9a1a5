"""Session factory with the settings every plan in this package assumes."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "waymesh", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC clocks, adaptive execution and Arrow transfer.

    On a cluster the submitter's own settings win: only unset keys are filled.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        cores = master[6:-1]
        defaults["spark.sql.shuffle.partitions"] = cores if cores.isdigit() else str(os.cpu_count() or 4)
        defaults["spark.driver.memory"] = os.environ.get("WAYMESH_DRIVER_MEMORY", "6g")
    return builder.config(map={**defaults, **conf}).getOrCreate()
