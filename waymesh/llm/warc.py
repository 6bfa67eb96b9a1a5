"""WARC archives with a two-level capture index.

Records are written by Spark tasks into the shared folder, one gzip member a record, and each
task reports (reversed-host key, file, offset, length) of what it wrote. The index sorts these
keys, with the page id behind them, over range partitions into compressed blocks; a sparse
directory keeps only each block's first and last key and its place.

A look-up is of one key or a range of keys. A bounded number of the directory's keys, its
fences, are broadcast and deal both directory and look-ups into stretches of the key order; in
its stretch a look-up is searched in the directory by bisection, the block it names is read by
range and searched by bisection, and the records found are read by range. No directory, block
list or hot URL is gathered in one place.

Of records with equal payloads of at least REVISIT_BYTES bytes the one with the largest page
id is a `response`, the others are `revisit` records that refer to it; shorter payloads are
always responses. A task writes under a name of its own, and only what a committed task
reported is indexed, so a task that is run again leaves an unused file and nothing else.

Defined results: a null html is an empty payload; a null page id is a response, never referred to; a null url has the key "-"; repeated rows
with the largest id are all responses; an empty table gives empty archives and an empty index.
"""
from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, stash

REVISIT_BYTES = 1000
#: Captures in one index block.
BLOCK = 512
#: Fences at the most, and directory entries between two of them at the least.
FENCES, BETWEEN = 1 << 16, 8
#: Sorts behind every page id.
LAST_ID = "~"
DATE = "2024-01-01T00:00:00Z"
#: Captures; a page id is text here, so that nulls and large ids pass pandas unchanged.
ENTRY = "surt string, page_id string, file string, offset bigint, length bigint"


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.a.org:80/x?y -> org,a,www)/x?y."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"-)/{url}"
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only, with the full payload's digest and size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _described(headers: dict[str, str], payload: bytes) -> dict:
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["WARC-Payload-Length"])):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": _page(headers["WARC-Record-ID"]), "payload_bytes": int(headers["WARC-Payload-Length"]), "payload_digest": digest,
        "record_type": kind, "refers_to": _page(headers.get("WARC-Refers-To")),
    }


def _table(rows: list[dict]) -> pd.DataFrame:
    out = {c: [r[c] for r in rows] for c in rows[0]}
    return pd.DataFrame(out | {c: pd.array(out[c], dtype="Int64") for c in ("page_id", "refers_to")})


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    newest = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("newest"))
    out = rows.join(newest, ["digest", "size"], "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") < F.col("newest"), F.col("newest"))).drop("newest")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page's record; returns the captures (surt, page_id, file, offset, length)."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                rows = []
                for digest, size, page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("digest", "size", "page_id", "url", "payload", "refers_to"))):
                    if out is None:
                        fs, path = pafs.FileSystem.from_uri(folder)
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}", compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    raw = gzip.compress(record(kind, page_id, url, payload, digest, size, refers_to), 6, mtime=0)
                    out.write(raw)
                    rows.append((surt(url), None if page_id is None else str(page_id), name, at, len(raw)))
                    at += len(raw)
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["surt", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stash(decide(pages).select("digest", "size", "page_id", "url", "payload", "refers_to").mapInArrow(run, ENTRY), "captures")


def build_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Write sorted, compressed blocks; returns the sparse directory (first, first_id, last, last_id, file, offset, length, n)."""
    folder = folder or new_path(captures.sparkSession, "index")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at, held = None, f"index-{uuid.uuid4().hex}.cdx", 0, []
        fs, path = pafs.FileSystem.from_uri(folder)

        def block(rows: list) -> dict:
            nonlocal out, at
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            raw = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode())
            out.write(raw)
            at += len(raw)
            return {"first": rows[0][0], "first_id": rows[0][1] or "", "last": rows[-1][0], "last_id": rows[-1][1] or "", "file": f"{folder}/{name}", "offset": at - len(raw), "length": len(raw), "n": len(rows)}

        for frame in frames:
            ids = [None if x is None or pd.isna(x) else x for x in frame["page_id"]]
            held += [list(r) for r in zip(frame["surt"], ids, frame["file"], frame["offset"].tolist(), frame["length"].tolist())]
            made = []
            while len(held) >= BLOCK:
                made.append(block(held[:BLOCK]))
                held = held[BLOCK:]
            if made:
                yield pd.DataFrame(made)
        if held:
            yield pd.DataFrame([block(held)])
        if out is not None:
            out.close()

    ranged = captures.repartitionByRange("surt", "page_id", "file", "offset").sortWithinPartitions("surt", "page_id", "file", "offset")
    return stash(ranged.mapInPandas(run, "first string, first_id string, last string, last_id string, file string, offset bigint, length bigint, n bigint"), "directory")


def _range(opened: dict, uri: str, offset: int, length: int) -> bytes:
    if uri not in opened:
        if len(opened) >= 16:
            opened.pop(next(iter(opened))).close()
        fs, path = pafs.FileSystem.from_uri(uri)
        opened[uri] = fs.open_input_file(path)
    return opened[uri].read_at(length, offset)


def read_block(opened: dict, uri: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(_range(opened, uri, offset, length)).decode().split("\n")]


def _key(row: list) -> tuple[str, str]:
    return row[0], row[1] or ""


def keys_of(pages: DataFrame) -> DataFrame:
    """Look-ups (surt, low, high) of each page by its key and its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), batch.column(1)], names=["surt", "low", "high"])

    page_id = F.coalesce(F.col("page_id").cast("bigint").cast("string"), F.lit(""))
    return pages.select(F.col("url").cast("string"), page_id.alias("page_id")).mapInArrow(run, "surt string, low string, high string").distinct()


class CaptureIndex:
    """Look-ups through the directory and its blocks."""

    def __init__(self, directory: DataFrame) -> None:
        self.directory = directory

    def fences(self) -> list[tuple[str, str]]:
        """Keys of the directory that part it, by a hash of their places; FENCES of them or a few more."""
        step = max(BETWEEN, -(-self.directory.count() // FENCES))
        some = self.directory.where(F.pmod(F.xxhash64("file", "offset"), F.lit(step)) == 0).select("first", "first_id").distinct().collect()
        return [("", ""), *sorted((r["first"], r["first_id"]) for r in some)]

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The captures of distinct look-ups (surt, low, high): those with that key and an id from low to high."""
        fences = keys.sparkSession.sparkContext.broadcast(self.fences())
        shape = "stretch int, tag int, surt string, low string, high string, file string, offset bigint, length bigint"

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = fences.value
            for frame in frames:
                first = [bisect.bisect_right(own, k) - 1 if t == 0 else max(0, bisect.bisect_left(own, k) - 1) for t, k in zip(frame["tag"], zip(frame["surt"], frame["low"]))]
                last = [bisect.bisect_right(own, k) - 1 for k in zip(frame["surt"], frame["high"])]
                # a range of keys, and a key that is a fence, are looked up in each stretch they reach
                frame["stretch"] = [range(a, b + 1) for a, b in zip(first, last)]
                yield frame.explode("stretch").astype({"stretch": "int32"})[["stretch", "tag", "surt", "low", "high", "file", "offset", "length"]]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict = {}
            stretch, firsts, places = None, [], []
            at, rows, found = None, [], []
            for batch in batches:
                for s, tag, key, low, high, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if s != stretch:
                        stretch, firsts, places = s, [], []
                    if tag == 0:
                        firsts.append((key, low))
                        places.append((file, offset, length))
                        continue
                    j = max(0, bisect.bisect_left(firsts, (key, low)) - 1)
                    while j < len(firsts) and firsts[j] <= (key, high):
                        if at != places[j]:
                            at, rows = places[j], read_block(opened, *places[j])
                        a, b = bisect.bisect_left(rows, (key, low), key=_key), bisect.bisect_right(rows, (key, high), key=_key)
                        found += rows[a:b]
                        j += 1
                    if len(found) >= 4096:
                        yield _captures(found)
                        found = []
            if found:
                yield _captures(found)

        none = [F.lit("").alias("file"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("length")]
        entries = self.directory.select(F.lit(0).alias("tag"), F.col("first").alias("surt"), F.col("first_id").alias("low"), F.col("first_id").alias("high"), "file", "offset", "length")
        asked = keys.select(F.lit(1).alias("tag"), "surt", "low", "high", *none)
        dealt = entries.union(asked).mapInPandas(deal, shape)
        # of a stretch first its part of the directory, which is in key order, then what is looked up in it
        return dealt.repartition("stretch").sortWithinPartitions("stretch", "tag", "surt", "low", "file", "offset").mapInArrow(search, ENTRY)

    def find(self, *urls: str) -> DataFrame:
        """All captures of the URLs."""
        spark = self.directory.sparkSession
        return self.look_up(spark.createDataFrame(sorted({(surt(u), "", LAST_ID) for u in urls}), "surt string, low string, high string"))


def _captures(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], names=["surt", "page_id", "file", "offset", "length"])


def read_records(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """Range-read every capture's record in file order, checking each response against its digest.

    payloads adds the payload itself (null for revisits, whose payload is that of refers_to).
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if payloads else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict = {}
        for frame in frames:
            rows = []
            for uri, offset, length in zip(frame["file"], frame["offset"], frame["length"]):
                headers, payload = parse(gzip.decompress(_range(opened, uri, int(offset), int(length))))
                row = _described(headers, payload)
                if payloads:
                    row["payload"] = payload if row["record_type"] == "response" else None
                rows.append(row)
                if payloads and len(rows) >= 256:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)

    # a stretch of a file of about 8 MB is one key: reads stay near each other and no file is one task
    stretch = F.floor(F.col("offset") / (8 << 20))
    return captures.repartition(F.col("file"), stretch).sortWithinPartitions("file", "offset").mapInPandas(run, schema)


def archive(pages: DataFrame) -> tuple[DataFrame, CaptureIndex]:
    captures = write_archives(pages)
    return captures, CaptureIndex(build_index(captures))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write and index every page, then look each page up and read its records back."""
    _, index = archive(pages)
    return read_records(index.look_up(keys_of(pages)))
