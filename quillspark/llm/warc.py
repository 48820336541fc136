"""Deterministic sharded WARC writer.

Records are ordered by URL (bytes), ``page_id`` and the digest of their content, and cut into shards by ranges of
that order.  The splitters are quantiles of the keys whose hash falls on a grid, so shards, files, offsets and
bytes are a function of the records and the parameters alone: neither the number of executors nor the order of
the input matters.  A task writes one shard and starts a new file when the compressed size passes
``file_bytes``; every file begins with a warcinfo record, every record is a gzip member of its own.  HTTP and WARC
headers, content lengths, record ids and SHA-1 digests are made anew from the content.

*Commit.*  Tasks write under names that hold their attempt, in ``_temporary``; the index rows of the attempt that
Spark commits say which of these count.  Then tasks rename the files (a repeated rename does nothing), the index is
there as Parquet, and ``MANIFEST.json``, itself written under another name first, appears last: a folder
without it isn't complete.  An executor that is lost leaves only temporary files, which the end removes.

Cases: a null URL counts as '', a null page as ''.  Null ids are written without an id header and sort first.
Repeated rows give a record each, with different record ids.  An empty table gives an empty manifest and no file.
A single record larger than ``file_bytes`` fills a file alone.  ``page_id``, ``url`` and ``html`` are read; other columns may
have any name.  A URL's control characters and spaces are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, shared_path, table

#: Content of a shard (one task writes it), and compressed bytes at which it starts another file.
SHARD_BYTES = 128 << 20
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_id string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 - the format's digest


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str, html: bytes, copy: int) -> tuple[bytes, str, str]:
    """(gzip member, payload digest, record id)."""
    payload = _digest(html)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(html)).encode() + b"\r\n\r\n" + html
    rid = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {page_id} {payload} {copy}')}>"
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url))]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    headers += [("WARC-Payload-Digest", payload), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return _member(headers, block), payload, rid


def splitters(keyed: DataFrame, shard_bytes: int) -> list[bytes]:
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum(F.length("html")), F.lit(0))).first()
    shards = max(1, -(-total // shard_bytes))
    if shards == 1:
        return []
    grid = max(1, n // (200 * shards))  # about 200 keys for each shard come to the driver
    keys = sorted(bytes(r[0]) for r in keyed.where(F.pmod(F.xxhash64("key"), F.lit(grid)) == 0).select("key").collect())
    return sorted({keys[len(keys) * k // shards] for k in range(1, shards)}) if keys else []


def write(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` below ``path`` (new or empty) and return the index: a row for each record."""
    spark = prepare(pages.sparkSession)
    filesystem, root = _open(path)
    filesystem.create_dir(f"{root}/_temporary", recursive=True)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    page_id = F.col("page_id").cast("long")
    at = F.when(page_id.isNull(), F.lit("")).otherwise(F.lpad(F.hex(page_id), 16, "0"))
    src = pages.select(page_id.alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.concat(F.encode(url, "utf-8"), F.unhex(F.lit("00")), F.encode(at, "utf-8")).alias("key"))
    cut = splitters(src, shard_bytes)
    shared = spark.sparkContext.broadcast(cut)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array([*shared.value, None], object)[:-1], keys.map(bytes).to_numpy(object), side="right").astype(np.int32) if shared.value else np.zeros(len(keys), np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(path)
        task = TaskContext.get()
        attempt = f"{task.stageId()}-{task.partitionId()}-{task.attemptNumber()}-{task.taskAttemptId()}"
        out, size, seq, sha, name, temp = None, 0, -1, None, "", ""
        last, copy, records = None, 0, 0
        ends: list[tuple[str, str, int, str, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                ends.append((temp, name, size, sha.hexdigest(), records))
                out = None

        for batch in batches:
            rows = []
            for page_id, url, html, shard in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "shard")), strict=True):
                data = html.encode("utf-8", "surrogatepass")
                same = (url, page_id, hashlib.sha1(data).digest())  # noqa: S324
                copy = copy + 1 if same == last else 0
                last = same
                member, payload, rid = record(page_id, url, data, copy)
                if out is None or size + len(member) > file_bytes:
                    close()
                    seq += 1
                    name = f"shard-{shard:06d}-{seq:05d}.warc.gz"
                    temp = f"_temporary/{name}.{attempt}"
                    out, sha, records = filesystem.open_output_stream(f"{root}/{temp}", compression=None), hashlib.sha256(), 0
                    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    sha.update(info)
                    size = len(info)
                out.write(member)
                sha.update(member)
                rows.append((page_id, url, name, size, len(member), payload, rid))
                size += len(member)
                records += 1
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64())], _NAMES)
        close()
        # a file's own row: its temporary name, checksum and records
        for temp, name, size, digest, records in ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([name]), pa.array([size], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([temp]), pa.array([digest]), pa.array([records], pa.int64())], _NAMES)

    sharded = src.withColumn("shard", shard_of("key"))
    rows = sharded.repartitionById(len(cut) + 1, F.col("shard")).sortWithinPartitions("key", F.sha1("html")).select("page_id", "url", "html", "shard")
    rows.mapInArrow(run, INDEX + ", temp string, sha256 string, records long").write.parquet(f"{path}/index")
    everything = spark.read.schema(INDEX + ", temp string, sha256 string, records long").parquet(f"{path}/index")
    commit(path, everything.where("temp is not null").select("file", "temp", "sha256", "records", F.col("offset").alias("bytes")))
    return everything.where("temp is null").select(*[c.split()[0] for c in INDEX.split(", ")])


_NAMES = [*[c.split()[0] for c in INDEX.split(", ")], "temp", "sha256", "records"]


def commit(path: str, files: DataFrame) -> None:
    """Rename what was written, then let the manifest appear.  Running it again does nothing more."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(path)
        for batch in batches:
            for name, temp in zip(batch.column("file").to_pylist(), batch.column("temp").to_pylist(), strict=True):
                if filesystem.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    try:
                        filesystem.move(f"{root}/{temp}", f"{root}/{name}")
                    except OSError:  # another attempt of this task was faster
                        if filesystem.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                            raise
            yield batch

    columns = "file string, temp string, sha256 string, records long, bytes long"
    done = files.repartition("file").mapInArrow(rename, columns)
    # one line for each file: about as many as there are shards
    listed = [{"file": r.file, "bytes": r.bytes, "records": r.records, "sha256": r.sha256} for r in done.drop("temp").orderBy("file").collect()]
    filesystem, root = _open(path)
    body = json.dumps({"date": DATE, "files": listed}, indent=1)
    with filesystem.open_output_stream(f"{root}/_temporary-manifest") as f:
        f.write(body.encode())
    filesystem.move(f"{root}/_temporary-manifest", f"{root}/MANIFEST.json")
    if filesystem.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        filesystem.delete_dir(f"{root}/_temporary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, record_id, url, page_id, digest_ok, html) of a committed folder, checked against its digests."""
    prepare(spark)
    filesystem, root = _open(path)
    with filesystem.open_input_stream(f"{root}/MANIFEST.json") as f:
        names = [x["file"] for x in json.loads(f.read())["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with filesystem.open_input_file(f"{root}/{name}") as f:
                    z, data = zlib.decompressobj(31), b""
                    rest = f.read(1 << 20)
                    while rest:
                        data += z.decompress(rest)
                        rest = z.unused_data
                        if z.eof:
                            rows.append(_parse(name, data))
                            z, data = zlib.decompressobj(31), b""
                        if not rest:
                            rest = f.read(1 << 20)
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000], strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["file", "type", "record_id", "url", "page_id", "digest_ok", "html"])

    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)), "file")
    return files.mapInArrow(run, "file string, type string, record_id string, url string, page_id long, digest_ok boolean, html string")


def _parse(name: str, data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(h["Content-Length"])]
    if h["WARC-Type"] != "response":
        return name, h["WARC-Type"], h["WARC-Record-ID"], None, None, None, None
    payload = block.partition(b"\r\n\r\n")[2]
    ok = h["WARC-Block-Digest"] == _digest(block) and h["WARC-Payload-Digest"] == _digest(payload)
    return name, "response", h["WARC-Record-ID"], h["WARC-Target-URI"], int(h["WARC-Page-ID"]) if "WARC-Page-ID" in h else None, ok, payload.decode("utf-8", "surrogatepass")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
