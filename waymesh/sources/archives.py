"""Zip archives of CSV members as a Spark data source, `waymesh_feed`.

Reading plans one task for each range of bytes of a member: the driver reads central directories
only, a task reads its range's lines. A stored member is entered at the range's own offset; a
deflated one has to be inflated from its start, which costs a task what stands before its range,
but no parsing; it has eight ranges at most, so that this work grows with its size and not with the square. Columns are those of the given schema, no other is converted; comparisons with
literals, sets, prefixes and null tests are pushed into the source and leave rows out before
they reach the JVM.

    spark.read.format("waymesh_feed").schema("trip_id string, stop_sequence int").option("member", "stop_times.txt").load(folder)

Options: path, a folder of archives, one archive, or a glob of local or shared paths, or a URI that
Arrow opens; member; splitBytes, the least size of a range before compression (64 MB); multiline, for
members whose quoted fields hold line breaks: such a member is one task.

Defined results: blanks are trimmed and empty fields are null; a column that a member lacks is
null; an archive without the member has no rows; a byte-order mark is dropped; a value that does
not fit its column's type, a row of another width and a damaged archive are errors.

Writing gives one archive for each task, named by the task and complete when the job commits.
"""
from __future__ import annotations

import glob
import io
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

NAME = "waymesh_feed"
#: Bytes of a member, before compression, that a task reads.
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20
#: Ranges of a deflated member at most: each inflates what stands before it, so that n of them inflate (n + 1) / 2 times the member.
DEFLATED_RANGES = 8


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)


def archives(path: str) -> list[str]:
    """The zip archives that a path names, in order."""
    if any(c in path for c in "*?[") and "://" not in path:
        return sorted(glob.glob(path))
    fs, local = file_system(path)
    info = fs.get_file_info(local)
    if info.type == pyarrow.fs.FileType.Directory:
        found = fs.get_file_info(pyarrow.fs.FileSelector(local, recursive=True))
        names = sorted(x.path for x in found if x.path.endswith(".zip"))
        scheme = path[: -len(local)] if path.endswith(local) else ""
        return [f"{scheme}{x}" for x in names]
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


@dataclass
class Range(ds.InputPartition):
    """Bytes [start, end) of a member, before compression."""

    archive: str
    member: str
    start: int
    end: int
    size: int


class Lines(io.RawIOBase):
    """A member's lines whose first byte is in [start, end), as one stream; the first line is left out."""

    def __init__(self, stream, start: int, end: int) -> None:
        self.stream, self.at, self.end = stream, start, end
        self.rest, self.done = b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest and not self.done:
            chunk = self.stream.read(_CHUNK)
            if not chunk:
                self.done = True
                break
            if self.at + len(chunk) >= self.end:
                # the line that begins before `end` is read to its own end
                cut = chunk.find(b"\n", max(0, self.end - 1 - self.at))
                if cut >= 0:
                    chunk, self.done = chunk[: cut + 1], True
            self.at += len(chunk)
            self.rest = chunk
        n = min(len(buffer), len(self.rest))
        buffer[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def _header(stream) -> tuple[list[str], int]:
    """(column names, bytes of the first line) of a member."""
    line = stream.readline()
    text = line.decode("utf-8-sig").strip("\r\n")
    parsed = pa.csv.read_csv(io.BytesIO((text + "\n").encode()), read_options=pa.csv.ReadOptions(autogenerate_column_names=True), convert_options=pa.csv.ConvertOptions(column_types=None)) if text else None
    names = [str(parsed[c][0].as_py() if parsed[c][0].as_py() is not None else "").strip() for c in parsed.column_names] if parsed is not None else []
    return names, len(line)


def _skip(stream, size: int) -> None:
    while size > 0:
        got = len(stream.read(min(size, _CHUNK)))
        if not got:
            return
        size -= got


def _entered(archive: zipfile.ZipFile, raw, member: str, at: int):
    """A stream of a member from byte `at` on."""
    info = archive.getinfo(member)
    if info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1:
        raw.seek(info.header_offset + 26)
        name, extra = struct.unpack("<HH", raw.read(4))
        raw.seek(info.header_offset + 30 + name + extra + at)
        return io.BufferedReader(_Limited(raw, info.file_size - at))
    stream = archive.open(member)
    _skip(stream, at)
    return stream


class _Limited(io.RawIOBase):
    def __init__(self, raw, left: int) -> None:
        self.raw, self.left = raw, left

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.raw.read(min(len(buffer), self.left))
        buffer[: len(got)] = got
        self.left -= len(got)
        return len(got)


_TYPES = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}


def _arrow(kind: T.DataType) -> pa.DataType:
    if type(kind) not in _TYPES:
        raise ValueError(f"{NAME} has no columns of type {kind.simpleString()}")
    return _TYPES[type(kind)]


_COMPARED = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


def mask(batch: pa.RecordBatch, f: ds.Filter) -> pa.Array:
    """Rows of batch that a pushed filter keeps."""
    column = batch.column(f.attribute[0])
    if type(f) in _COMPARED:
        kept = _COMPARED[type(f)](column, pa.scalar(f.value, column.type))
    elif isinstance(f, ds.In):
        kept = pc.and_(pc.is_in(column, value_set=pa.array([x for x in f.value if x is not None], column.type)), pc.is_valid(column))
    elif isinstance(f, ds.StringStartsWith):
        kept = pc.starts_with(column, f.value)
    else:
        kept = pc.is_null(column) if isinstance(f, ds.IsNull) else pc.is_valid(column)
    return pc.fill_null(kept, False)


class FeedReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.member = options.get("path"), options.get("member")
        if not self.path or not self.member:
            raise ValueError(f"{NAME} needs a path and the option member")
        self.split, self.whole = int(options.get("splitBytes", SPLIT_BYTES)), str(options.get("multiline", "false")).lower() == "true"
        self.columns = [(f.name, _arrow(f.dataType)) for f in schema.fields]
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        known = dict(self.columns)
        for f in filters:
            fits = isinstance(f, (*_COMPARED, ds.In, ds.IsNull, ds.IsNotNull, ds.StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in known
            if fits and isinstance(f, tuple(_COMPARED)):
                fits = isinstance(f.value, (str, int, float, bool))
            if fits:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        out = []
        for name in archives(self.path):
            fs, local = file_system(name)
            with fs.open_input_file(local) as raw, zipfile.ZipFile(raw) as z:
                if self.member not in z.namelist():
                    continue
                info = z.getinfo(self.member)
                size = info.file_size
            step = max(1, size if self.whole else self.split)
            if info.compress_type != zipfile.ZIP_STORED:
                step = max(step, -(-size // DEFLATED_RANGES))
            out += [Range(name, self.member, a, min(size, a + step), size) for a in range(0, max(size, 1), step)]
        return out or [Range("", self.member, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, local = file_system(part.archive)
        with fs.open_input_file(local) as raw, zipfile.ZipFile(raw) as z:
            with z.open(part.member) as stream:
                names, first = _header(stream)
            # a range begins at the first line that starts in it: the byte before tells whether one does
            start = max(first, part.start)
            if start >= part.size or not names:
                return
            stream = _entered(z, raw, part.member, start - 1)
            before = stream.read(1)
            at = start
            if before != b"\n":
                at += len(stream.readline())
            if at >= part.end:
                return
            yield from self._parsed(io.BufferedReader(Lines(stream, at, part.end), _CHUNK), names)

    def _parsed(self, lines, names: list[str]) -> Iterator[pa.RecordBatch]:
        read = pa.csv.ReadOptions(column_names=names, use_threads=False, block_size=_CHUNK)
        wanted = [c for c, _ in self.columns]
        convert = pa.csv.ConvertOptions(include_columns=wanted, include_missing_columns=True, column_types={c: pa.string() for c in wanted}, strings_can_be_null=False)
        try:
            table = pa.csv.open_csv(pa.PythonFile(lines, mode="r"), read_options=read, parse_options=pa.csv.ParseOptions(newlines_in_values=self.whole), convert_options=convert)
        except pa.ArrowInvalid as error:
            if "Empty CSV" in str(error):
                return
            raise
        for batch in table:
            columns = []
            for c, kind in self.columns:
                text = pc.utf8_trim_whitespace(batch.column(c).cast(pa.string()))
                text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
                columns.append(text if kind == pa.string() else text.cast(kind))
            out = pa.RecordBatch.from_arrays(columns, names=wanted)
            for f in self.filters:
                out = out.filter(mask(out, f))
            if out.num_rows:
                yield out


@dataclass
class Written(ds.WriterCommitMessage):
    temporary: str
    final: str


class FeedWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.member = options.get("path"), options.get("member")
        if not self.path or not self.member:
            raise ValueError(f"{NAME} needs a path and the option member")
        self.stored = str(options.get("stored", "false")).lower() == "true"
        for f in schema.fields:
            _arrow(f.dataType)
        self.header = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, local = file_system(self.path)
        fs.create_dir(local, recursive=True)
        final = f"{local}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.zip"
        temporary = final + ".tmp"
        with fs.open_output_stream(temporary) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED if self.stored else zipfile.ZIP_DEFLATED) as z, z.open(self.member, "w", force_zip64=True) as member:
            with pa.csv.CSVWriter(pa.PythonFile(member, mode="w"), self.header) as out:
                for batch in batches:
                    out.write_batch(batch.cast(self.header))
        return Written(temporary, final)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class FeedArchives(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError(f"{NAME} needs a schema")

    def reader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> FeedWriter:
        if overwrite:
            raise ValueError(f"{NAME} adds archives; it replaces none")
        return FeedWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make `waymesh_feed` known to the session, and let filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedArchives)
