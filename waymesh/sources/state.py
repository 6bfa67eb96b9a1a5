"""Keyed caches, job states, manifests and snapshots as tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(request: Column) -> Column:
    """SHA-256 of a request struct's canonical JSON (fields in the struct's order)."""
    return F.sha2(F.to_json(request), 256)


def lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached columns, misses) by `key`."""
    return requests.join(cache, "key"), requests.join(cache, "key", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merge of job states (key, state[, attempts]): a done job stays done, any other takes the new state."""
    b = new.select(key, F.col("state").alias("__new"), F.lit(True).alias("__in"))
    both = old.join(b, key, "full_outer")
    done = F.coalesce(F.col("state") == "done", F.lit(False))
    tried = F.coalesce("attempts", F.lit(0)) + F.when(F.col("__in") & ~done, 1).otherwise(0)
    return both.select(key, F.when(done, F.lit("done")).otherwise(F.coalesce("__new", "state")).alias("state"), tried.alias("attempts"))


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(files: DataFrame, group: list[str]) -> DataFrame:
    """(group.., n_files, bytes, digest): files are dealt by the first digits of their path's SHA-256; each deal
    has a digest over its 'path:sha256' lines in path order, a group one over its deals' digests in their order.

    So a task holds a 4096th of a group's lines, and then at most 4096 digests.
    """
    rows = files.select(*group, "path", F.octet_length("content").cast("bigint").alias("size"), F.concat_ws(":", F.col("path").cast("string"), F.sha2("content", 256)).alias("line"))
    lines = lambda key, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(line).alias("v")))), lambda x: x["v"]), "\n")
    dealt = rows.withColumn("deal", F.substring(F.sha2(F.col("path").cast("string").cast("binary"), 256), 1, 3))
    deals = dealt.groupBy(*group, "deal").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.md5(lines("path", "line")).alias("part"))
    return deals.groupBy(*group).agg(F.sum("n").alias("n_files"), F.sum("size").alias("bytes"), F.md5(lines("deal", "part")).alias("digest"))


def manifest_problems(found: DataFrame, expected: DataFrame, allowed: str = r"^[A-Za-z0-9_./-]+$") -> DataFrame:
    """(path, problem): missing, unexpected, changed, or unsafe paths (absolute, with '..', or not of the allowed form)."""
    a = expected.select("path", F.col("sha256").alias("want"), F.col("size").alias("want_size"))
    b = found.select("path", F.col("sha256").alias("have"), F.col("size").alias("have_size"))
    unsafe = F.col("path").startswith("/") | F.col("path").contains("..") | ~F.col("path").rlike(allowed)
    both = a.join(b, "path", "full_outer")
    problem = F.when(unsafe, "unsafe_path").when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when((F.col("have") != F.col("want")) | (F.col("have_size") != F.col("want_size")), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def stale_stages(stages: DataFrame, before: DataFrame) -> DataFrame:
    """stages (seq, name, digest) with `rerun`: a stage reruns if its digest changed or an earlier one reruns."""
    from pyspark.sql import Window

    old = before.select("name", F.col("digest").alias("__old"))
    changed = stages.join(old, "name", "left").withColumn("__c", (~F.col("digest").eqNullSafe(F.col("__old"))).cast("int"))
    order = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # the stages of one build: a dozen rows
    return changed.withColumn("rerun", F.max("__c").over(order) == 1).drop("__c", "__old")


class Snapshots:
    """Versioned Parquet snapshots of table sets, published by moving one pointer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, version: str, tables: dict[str, DataFrame]) -> None:
        for name, frame in tables.items():
            frame.write.parquet(f"{self.root}/{version}/{name}")

    def read(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def publish(self, version: str) -> None:
        """Point readers at a version; the one before stays for rollback."""
        now = self.current()
        if now:
            self._put("PREVIOUS", now)
        self._put("CURRENT", version)

    def rollback(self) -> str | None:
        before = self._get("PREVIOUS")
        if before:
            self._put("CURRENT", before)
        return before

    def current(self) -> str | None:
        return self._get("CURRENT")

    def _put(self, name: str, text: str) -> None:
        fs, part, whole = self._fs(), self._path(f"{name}.part"), self._path(name)
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(whole, False)
        fs.rename(part, whole)

    def _get(self, name: str) -> str | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
