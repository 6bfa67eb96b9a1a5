"""Keyed state over batches: a cache whose entries go stale, and a log with a cursor.

State lives in the state store (RocksDB) as typed values with timers, not in pickled objects, so it
is kept over restarts and never held whole by a task. Both processors see a key's rows in the order
of their time inside a batch; batches come in the order of the source.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a fetched answer serves requests; fixed value.
FRESH_S = 15


class _StateStore:
    """For the streams started inside: the state store that keyed processors need; the session's own comes back."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, PROVIDER)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(self.KEY)
        else:
            self.conf.set(self.KEY, self.before)


class _Cache(StatefulProcessor):
    """Per key the time of the last fetch, forgotten by a timer once it is stale."""

    def __init__(self, key: list[str], carried: str, seconds: float) -> None:
        self.key, self.carried, self.seconds = key, carried, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at_ms", self.carried], kind="stable")
        last = int(self.fetched.get()[0]) if self.fetched.exists() else None
        before, out = last, []
        for at in frame["at_ms"]:
            hit = last is not None and at < last + 1000 * self.seconds
            if not hit:
                last = int(at)
            out.append((hit, last))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(int(before + 1000 * self.seconds))
            self.fetched.update((last,))
            self.handle.registerTimer(int(last + 1000 * self.seconds))
        result = frame[[*self.key, self.carried]].copy()
        result["hit"] = [h for h, _ in out]
        result["age_ms"] = [int(at) - f for at, (_, f) in zip(frame["at_ms"], out)]
        yield result

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.fetched.exists() and int(self.fetched.get()[0]) + 1000 * self.seconds <= expiredTimerInfo.getExpiryTimeInMs():
            self.fetched.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, key: list[str], time: str, carried: str, seconds: float = FRESH_S, delay: str = "0 seconds") -> DataFrame:
    """(key.., carried, hit, age_ms) of a stream of requests: whether the last answer for the key still serves.

    A request within `seconds` of the key's last fetch is a hit, else it fetches. Entries go when
    the watermark (time less delay) passes their end, so keys that nobody asks for hold no state.
    """
    ms = F.unix_millis(F.col(time)).alias("at_ms")
    rows = requests.withWatermark(time, delay).select(*key, carried, time, ms)
    fields = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*key, carried]) + ", hit boolean, age_ms bigint"
    return rows.groupBy(*key).transformWithStateInPandas(_Cache(key, carried, seconds), schema, "append", "eventTime")


class _Log(StatefulProcessor):
    """Per key the number of entries so far."""

    def __init__(self, key: list[str], order: list[str]) -> None:
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.length = handle.getValueState("length", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        n = int(self.length.get()[0]) if self.length.exists() else 0
        self.length.update((n + len(frame),))
        frame["seq"] = range(n + 1, n + len(frame) + 1)
        yield frame

    def close(self) -> None:
        pass


def appended(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A stream of entries with `seq`, 1, 2, .. in each key: those of later batches come behind."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields) + ", seq bigint"
    return entries.groupBy(*key).transformWithStateInPandas(_Log(key, order), schema, "append", "none")


def since(log: DataFrame, cursors: DataFrame, key: list[str]) -> DataFrame:
    """The entries behind each reader's cursor: cursors (reader, key.., seq), the last entry it has."""
    c = cursors.withColumnRenamed("seq", "__seen")
    return log.join(c, key).where(F.col("seq") > F.col("__seen")).drop("__seen")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive a stream over what its source holds now into Parquet at path, and read that."""
    spark = stream.sparkSession
    with _StateStore(spark):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    return spark.read.schema(stream.schema).parquet(path)
