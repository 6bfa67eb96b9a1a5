"""What the corpus operators share: the shared work folder, Arrow access and distributed labels."""
from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a fresh local one only where it is unset and there are no other machines."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="waymesh-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/waymesh-{uuid.uuid4().hex}/{name}"
    _MADE.append((spark, path.rsplit("/", 1)[0]))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table whose readers are done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _MADE:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and the folder with it
            return


#: Rows of a file of a narrow table.
ROWS_A_FILE = 250_000


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors.

    rows: what a narrow table has at the most. It is written in files of ROWS_A_FILE rows, not
    in one for each task: for each file an executor asks the store three times, and where that
    is a local folder starts a process each time.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._waymesh_path = path
    return out


def unstash(df: DataFrame) -> None:
    if path := getattr(df, "_waymesh_path", None):
        drop(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: Most bytes of an Arrow batch between the JVM and Python, on both sides of which it is held.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_BYTES: long texts else fill a batch of many rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if now is None or int(now[1]) <= 0 or int(now[1]) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run, a generator over Arrow batches, giving freed memory back to the system when it ends.

    Python workers live on between tasks; what their allocators keep counts against the executor.
    """

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without copying: (all bytes, starts, ends); nulls are empty."""
    n = len(column)
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        zero = np.zeros(n, np.int64)
        return np.zeros(0, np.uint8), zero, zero.copy()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        null = np.asarray(column.is_null())
        ends[null] = starts[null]
    return bytes_, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(starts)
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + most, side="right"))
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def connected(spark: SparkSession, edges: DataFrame, name: str = "cc", rows: int | None = None) -> DataFrame:
    """(a, b) edges of bigint ids -> (node, label): the smallest id that each node reaches.

    Alternating large-star and small-star steps; every step groups by node with a partial
    minimum and joins it back, so a node with very many edges is never gathered in one task.
    Each round's edges are a written table, never of more rows than the one before; the first
    has as many as edges at the most (rows, if known). Isolated nodes do not appear.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, seen = stash(pairs, f"{name}-0", rows), None
    step, rows = 0, now.count()
    while True:
        step += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.where("v = m").select("u", "v")).distinct()
        after = stash(small, f"{name}-{step}", rows)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        unstash(now)
        now, rows = after, mark[0]
        if mark == seen:
            break
        seen = mark
    out = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    both = out.union(out.select(F.col("label").alias("node"), "label"))
    done = stash(both.distinct(), f"{name}-labels", 2 * rows)
    unstash(now)
    return done


class Forest:
    """Union-find over positions 0..n-1; the root is the smallest position."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


#: Bits of the set of ids that keeps most other rows from a join, and bits of one of its pages.
ID_BITS, PAGE_BITS = 1 << 23, 1 << 15


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in ids (one column, no nulls); null ids stay.

    A bitmap of id hashes of fixed size (1 MB) is broadcast. Rows that miss it stay where they
    are; only the others meet ids in a join.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(ID_BITS))
    gone = ids.select(F.col(id_col).alias("__gone"))
    pages = gone.select(F.pmod(F.xxhash64("__gone"), F.lit(ID_BITS)).alias("p")).groupBy(F.floor(F.col("p") / PAGE_BITS).alias("__page")).agg(F.bitmap_construct_agg(F.col("p") % PAGE_BITS).alias("__map"))
    pages = stash(pages, "pages")
    bit = place % PAGE_BITS
    byte = F.conv(F.hex(F.substring(F.col("__map"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & F.col(id_col).isNotNull()
    told = docs.join(F.broadcast(pages), F.floor(place / PAGE_BITS) == F.col("__page"), "left").withColumn("__hit", hit)
    stay = told.where(~F.col("__hit")).select(*docs.columns)
    met = told.where("__hit").join(gone, F.col(id_col) == F.col("__gone"), "left_anti").select(*docs.columns)
    return stay.union(met)
