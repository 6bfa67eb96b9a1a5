"""Readers of the driver tables and the derived relations that several queries share."""
from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_seconds(ts: str = "ts") -> Column:
    """Whole seconds since 2024-01-01 of a zone-less timestamp."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


#: The same in DuckDB.
EVENT_S = "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("s", event_seconds())


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a half-open window (user_id, event_id, a, b) of 10 to 70 minutes."""
    return events(spark, sf_dir).select("user_id", "event_id", F.col("s").alias("a"), (F.col("s") + 600 + (F.col("event_id") % 7) * 600).alias("b"))


WINDOWS = f"(SELECT user_id, event_id, {EVENT_S} AS a, {EVENT_S} + 600 + (event_id % 7) * 600 AS b FROM events)"


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered role array of every conversation."""
    c = t(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))


ROLES = "(SELECT conv_id, list(role ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id)"


_FOLDERS: list = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see, under spark.checkpoint.dir; removed when the driver ends.

    Where that is unset a local folder is taken, on a local master only.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="waymesh-")
    path = f"{shared.rstrip('/')}/waymesh-{uuid.uuid4().hex}-{name}"
    _FOLDERS.append((spark, path))
    return path


@atexit.register
def _drop_folders() -> None:
    for spark, path in _FOLDERS:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone
            return
