import base64
import gzip
import hashlib
import io
import json
import os

from pyspark.sql import functions as F

from quillspark.llm import warc


def manifest(path):
    with open(f"{path}/MANIFEST.json") as f:
        return json.load(f)["files"]


def local(spark, name):
    return warc.shared_path(spark, name).removeprefix("file:")


def test_read_back_and_byte_ranges(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = local(spark, "w")
    index = warc.write(pages, path, shard_bytes=64 << 10, file_bytes=8 << 10).collect()
    rows = [r for r in warc.read(spark, path).collect() if r.type == "response"]
    assert sorted((r.page_id, r.html) for r in rows) == sorted((r.page_id, r.html) for r in pages.collect())
    assert all(r.digest_ok for r in rows)
    assert len(index) == len(rows)
    assert len(manifest(path)) > 1
    for r in index:  # a record is a gzip member of its own
        with open(f"{path}/{r.file}", "rb") as f:
            f.seek(r.offset)
            assert r.record_id in gzip.decompress(f.read(r.length)).decode()
    assert not os.path.exists(f"{path}/_temporary")


def test_bytes_dont_depend_on_partitioning(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    a, b = local(spark, "a"), local(spark, "b")
    warc.write(pages.repartition(7), a, shard_bytes=64 << 10, file_bytes=8 << 10)
    warc.write(pages.orderBy(F.desc("page_id")).coalesce(2), b, shard_bytes=64 << 10, file_bytes=8 << 10)
    assert manifest(a) == manifest(b)


def test_records_by_a_parser_of_its_own(spark, sf):
    """The format read line by line from the inflated files, with nothing of the writer."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = local(spark, "plain")
    warc.write(pages, path, shard_bytes=64 << 10, file_bytes=8 << 10)
    found = []
    for f in manifest(path):
        with open(f"{path}/{f['file']}", "rb") as stored:
            raw = stored.read()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"]
        assert len(raw) == f["bytes"]
        data = io.BytesIO(gzip.decompress(raw))
        while line := data.readline():
            assert line == b"WARC/1.1\r\n"
            head = {}
            while (line := data.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = data.read(int(head["Content-Length"]))
            assert data.read(4) == b"\r\n\r\n"
            if head["WARC-Type"] == "response":
                html = block.split(b"\r\n\r\n", 1)[1]
                for name, part in (("WARC-Block-Digest", block), ("WARC-Payload-Digest", html)):
                    assert head[name] == "sha1:" + base64.b32encode(hashlib.sha1(part).digest()).decode()
                found.append((int(head["WARC-Page-ID"]), head["WARC-Target-URI"], html.decode()))
    want = sorted((r.page_id, r.url, r.html) for r in pages.collect())
    assert sorted(found) == want
    assert [u for _, u, _ in found] == sorted(u for _, u, _ in found)  # shards are ranges in the order of URLs


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "http://x/ y\r\n", "a", 2), (2, "http://x/", "", 3), (2, "http://x/", "", 3), (3, "http://x/z", "é" * 300_000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, shard int")
    path = local(spark, "odd")
    index = warc.write(df, path, file_bytes=1024).collect()
    assert len({r.record_id for r in index}) == len(index) == 5
    back = [r for r in warc.read(spark, path).collect() if r.type == "response"]
    assert sorted((r.page_id or 0, r.html) for r in back) == sorted((r[0] or 0, r[2] or "") for r in rows)
    assert warc.write(df.where("false"), path := local(spark, "none")).count() == 0
    assert manifest(path) == []
    assert warc.read(spark, path).count() == 0


def test_commit_again_changes_nothing(spark, sf):
    path = local(spark, "again")
    warc.write(spark.read.parquet(f"{sf}/pages.parquet"), path)
    before = manifest(path)
    files = spark.createDataFrame([(x["file"], "gone", x["sha256"], x["records"], x["bytes"]) for x in before], "file string, temp string, sha256 string, records long, bytes long")
    warc.commit(path, files)
    assert manifest(path) == before
