"""Incremental rebuilds: what changed in the inputs, what that touches downstream, and one pointer to the result.

Tables are cut into parts, whose names are not null. A build digests every part of its base tables, compares with the last
published build, and recomputes in each stage the parts that its changed inputs touch. A
recomputed part whose digest is what it was touches nothing further. New parts are written
under a new version, the others stay where they are; the manifest (stage, part, version, digest)
says where each is, and a build is published by moving one pointer file. A failed build leaves the
last one as it was.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_MANIFEST = "stage string, part string, version string, digest string"
POINTER = "CURRENT"


def digests(rows: DataFrame, part: str = "part") -> DataFrame:
    """(part, digest) of rows: equal for equal multisets of rows, whatever their order and files.

    The count, and sum and xor of two 64-bit hashes of each row: aggregated before the shuffle,
    one row a part after it.
    """
    columns = sorted(c for c in rows.columns if c != part)
    # nulls are told from empty values, since a hash passes them over
    marked = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    a, b = F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *marked)
    got = rows.select(F.col(part).cast("string").alias("part"), a.alias("a"), b.alias("b")).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(20,0)")).alias("s"), F.bit_xor("b").alias("x"))
    return got.select("part", F.substring(F.sha2(F.concat_ws(":", "n", "s", "x"), 256), 1, 32).alias("digest"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(part, change) of digests (part, digest): added, removed or changed."""
    o = old.select("part", F.col("digest").alias("__o"))
    met = new.join(o, "part", "full_outer")
    change = F.when(F.col("__o").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("__o"), "changed")
    return met.select("part", change.alias("change")).where("change IS NOT NULL")


@dataclass(frozen=True)
class Stage:
    """run maps its inputs, cut to what the wanted parts need, to rows with `part`.

    touches(input, parts) gives the output parts that parts of an input go into, and needs(input,
    parts) the input's parts that output parts are made of; by default both are the same parts.
    A new version recomputes all.
    """

    name: str
    inputs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    touches: Callable[[str, DataFrame], DataFrame] = lambda _, parts: parts
    needs: Callable[[str, DataFrame], DataFrame] = lambda _, parts: parts
    version: str = "1"

    @property
    def mark(self) -> str:
        return f"{self.name}@{self.version}"


class Store:
    """Versions of stages' parts under one folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> str | None:
        """The published build's name."""
        fs, path = self._at(POINTER)
        if not fs.exists(path):
            return None
        with_ = fs.open(path)
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")).strip()
        finally:
            with_.close()

    def manifest(self, build: str | None = None) -> DataFrame:
        build = build or self.current()
        if build is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{build}")

    def read(self, stage: Stage, schema: StructType | str, build: str | None = None) -> DataFrame:
        """A stage's rows in a build: of every part its version."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return self._rows(stage.mark, self.manifest(build), plain(schema))

    def _rows(self, stage: str, manifest: DataFrame, schema: StructType) -> DataFrame:
        own = manifest.where(F.col("stage") == stage).select("version", F.col("part"))
        fs, path = self._at(f"tables/{stage}")
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        # version and part are partition columns: files of other versions and parts are not opened
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("version", StringType())])).parquet(str(path))
        return rows.join(own, ["version", "part"], "left_semi").drop("version")

    def publish(self, build: str) -> None:
        """Move the pointer to a build whose manifest is written: the one step that readers see."""
        fs, path = self._at(POINTER)
        _, temporary = self._at(f"{POINTER}.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(build.encode()))
        out.close()
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(temporary, path):
            raise OSError(f"{POINTER} was not moved")


def rebuild(store: Store, tables: dict[str, DataFrame], stages: list[Stage]) -> tuple[str, DataFrame]:
    """(build, report): bring all stages up to date with tables, and publish.

    tables: base tables with a column `part`. report: (stage, part, change) of what was recomputed.
    """
    spark, build = store.spark, uuid.uuid4().hex
    before = store.manifest().persist()
    scratch = f"{store.path}/work/{build}"
    written = 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal written
        written += 1
        df.write.parquet(f"{scratch}/{written}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{written}")

    entries, reports = [], []
    state: dict[str, DataFrame] = {}  # by table or stage, its changed parts
    rows: dict[str, DataFrame] = dict(tables)
    for name, table in tables.items():
        new = kept(digests(table))
        state[name] = kept(changed(before.where(F.col("stage") == name).select("part", "digest"), new))
        entries.append(new.select(F.lit(name).alias("stage"), "part", F.lit(None).cast("string").alias("version"), "digest"))
    for stage in stages:
        mark = stage.mark
        known = before.where(F.col("stage") == mark).select("part", "version", "digest")
        if known.isEmpty():  # new, or of another version: all parts
            wanted = None
            for name in stage.inputs:
                parts = stage.touches(name, rows[name].select(F.col("part").cast("string").alias("part")).distinct())
                wanted = parts if wanted is None else wanted.unionByName(parts)
        else:
            wanted = None
            for name in stage.inputs:
                parts = stage.touches(name, state[name].select("part"))
                wanted = parts if wanted is None else wanted.unionByName(parts)
        wanted = kept(wanted.select("part").distinct())
        inputs = {name: rows[name].join(stage.needs(name, wanted).select("part").distinct(), "part", "left_semi") for name in stage.inputs}
        made = stage.run(inputs).join(wanted, "part", "left_semi")
        schema = made.schema
        made.withColumn("version", F.lit(build)).write.partitionBy("version", "part").mode("append").parquet(f"{store.path}/tables/{mark}")
        fresh = store._rows(mark, wanted.select(F.lit(mark).alias("stage"), "part", F.lit(build).alias("version")), plain(schema))
        new = kept(digests(fresh).withColumn("version", F.lit(build)))
        state[stage.name] = kept(changed(known.join(wanted, "part", "left_semi").select("part", "digest"), new.select("part", "digest")))
        # a part that came out as it was keeps its old version, and what reads it is left alone
        same = known.join(new.select("part", F.col("digest").alias("__d")), "part").where("digest = __d").select("part")
        replaced = new.join(same, "part", "left_anti")
        stay = known.join(wanted, "part", "left_anti").unionByName(known.join(same, "part", "left_semi"))
        entry = kept(replaced.select("part", "version", "digest").unionByName(stay.select("part", "version", "digest")).select(F.lit(mark).alias("stage"), "part", "version", "digest"))
        entries.append(entry)
        reports.append(wanted.join(state[stage.name], "part", "left").select(F.lit(stage.name).alias("stage"), "part", F.coalesce("change", F.lit("same")).alias("change")))
        rows[stage.name] = store._rows(mark, entry, plain(schema))
    manifest, report = entries[0], reports[0]
    for e in entries[1:]:
        manifest = manifest.unionByName(e)
    for r in reports[1:]:
        report = report.unionByName(r)
    manifest.write.parquet(f"{store.path}/manifests/{build}")
    report = kept(report)
    store.publish(build)
    before.unpersist()
    return build, report


def plain(schema: StructType) -> StructType:
    """schema with `part` as text, as it is read back from a partition column."""
    return StructType([StructField(f.name, StringType() if f.name == "part" else f.dataType) for f in schema.fields])
