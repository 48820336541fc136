"""Durable indexes: generations of Parquet tables, a mutation log, and a pointer that is swapped.

A generation is a folder with the tables of an index; postings are written sorted by term, within runs of documents or (by a
commit) within ranges of (field, term), so a term's pages are found by their statistics, and the dictionary and the fields'
statistics are tables of their own, so a query counts nothing again.  The pointer (one small JSON file, replaced at once) names
the committed generation and the last mutation in it, so replaying the log twice does nothing twice.  A log file holds
one batch of mutations, a JSON line (seq, op, doc, field, term, crc) each, and its name is the first number in it, so
every line's number is known from its place; replay stops before the first line that isn't what it should be.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.index import DELETES, Index, IndexSpec, analyzed, build_index, postings_of
from quillspark.operators.inverted import inverted, invertible
from quillspark.sources.folders import Folder, scratch

RECORD = "seq long, op string, doc string, field string, term string, crc long"
_TABLES = ("docs", "postings", "lengths", "deletes", "dictionary", "stats")


# ---- segments


def write_segment(index: Index, path: str, partitions: int | None = None) -> None:
    """The tables of an index below ``path``; soft-deleted documents stay in it."""
    _postings(index.postings, path, partitions)
    index.docs.write.parquet(f"{path}/docs")
    index.lengths.write.parquet(f"{path}/lengths")
    _statistics(index, path)


def build_segment(df: DataFrame, spec: IndexSpec, path: str, partitions: int | None = None) -> Index:
    """Index rows straight into a segment: texts are analyzed once, where they are, and all tables come from what that wrote.

    Rows that share a ``doc_id`` share its postings, so these few are brought together; so are all rows where the analyzer is
    a column expression or a field has several values.
    """
    spark = df.sparkSession
    key = F.col("doc_id").cast("long")
    fast = invertible(df, spec)
    shared = df.groupBy(key.alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared") if fast else None
    some = not fast or not shared.isEmpty()
    if fast:
        inverted(df.join(shared, key.eqNullSafe(F.col("shared")), "left_anti") if some else df, spec).write.parquet(f"{path}/postings")
    if some:
        analyzed(df.join(shared, key.eqNullSafe(F.col("shared")), "left_semi") if fast else df, spec).write.parquet(f"{path}/analyzed")
        rows = spark.read.parquet(f"{path}/analyzed")
        _postings(postings_of(rows), path, partitions)
        rows.select("doc_id", "field", "len").write.parquet(f"{path}/lengths")
        Folder(spark, path).remove("analyzed")
    if fast:
        spark.read.parquet(f"{path}/postings").where("tf = 0").select("doc_id", "field", "len").write.mode("append").parquet(f"{path}/lengths")
    df.write.parquet(f"{path}/docs")
    _statistics(Index(df, spark.read.parquet(f"{path}/postings").where("tf > 0"), spark.read.parquet(f"{path}/lengths")), path)
    return read_segment(spark, path, spec)


def _postings(rows: DataFrame, path: str, partitions: int | None) -> None:
    ranged = rows.repartitionByRange(partitions, "field", "term", "doc_id") if partitions else rows.repartitionByRange("field", "term", "doc_id")
    ranged.sortWithinPartitions("field", "term", "doc_id").write.mode("append").parquet(f"{path}/postings")


def _statistics(index: Index, path: str) -> None:
    spark = index.docs.sparkSession
    spark.read.parquet(f"{path}/postings").where("tf > 0").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")).sortWithinPartitions("field", "term").write.parquet(f"{path}/dictionary")
    index.measured_fields().coalesce(1).write.parquet(f"{path}/stats")
    dead = index.deletes if index.deletes is not None else spark.createDataFrame([], DELETES)
    dead.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.parquet(f"{path}/deletes")
    sums = [[r.file, r.crc] for r in checksums(spark, path).orderBy("file").collect()]  # one for each file
    Folder(spark, path).write("checksums.json", json.dumps(sums).encode())


def read_segment(spark: SparkSession, path: str, spec: IndexSpec | None = None, verify: bool = False) -> Index:
    """``verify``: compare all files with the checksums of their writing first."""
    if verify and (bad := damaged(spark, path).limit(5).collect()):
        raise OSError(f"damaged or missing files of {path}: {[r.file for r in bad]}")
    t = {n: spark.read.parquet(f"{path}/{n}") for n in _TABLES}
    return Index(t["docs"], t["postings"].where("tf > 0"), t["lengths"], t["deletes"], spec, t["dictionary"], t["stats"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, crc, length) of every data file of a segment."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+/[^/]+$", 0).alias("file"), F.crc32("content").alias("crc"), "length").where("file NOT LIKE 'analyzed/%'")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file) of those that aren't as they were written."""
    told = spark.createDataFrame([tuple(x) for x in json.loads(Folder(spark, path).read("checksums.json"))], "file string, told long")
    return told.join(checksums(spark, path), "file", "left").where("crc IS NULL OR crc <> told").select("file")


_STORED: dict[tuple, str] = {}


def stored_index(source: DataFrame, spec: IndexSpec, rows: DataFrame) -> Index:
    """``rows`` (made from ``source``, which reads files) as a segment that is built once for a session and these files.

    A file that changes makes another segment.
    """
    spark = source.sparkSession
    files = tuple((f, *Folder(spark, f).stamp()) for f in sorted(source.inputFiles()))
    key = (spark.sparkContext.applicationId, tuple(spec.fields.items()), repr(spec.analyzer), files)
    if key not in _STORED:
        path = scratch(spark, "index")
        build_segment(rows, spec, path)
        _STORED[key] = path
    return read_segment(spark, _STORED[key], spec)


# ---- mutation log


def record_crc() -> Column:
    return F.crc32(F.concat_ws("\u0001", F.col("seq").cast("string"), "op", F.coalesce("doc", F.lit("")), F.coalesce("field", F.lit("")), F.coalesce("term", F.lit(""))).cast("binary"))


def log_records(files: DataFrame) -> DataFrame:
    """Records of log files (first, text): ``first`` is the number of a file's first line.

    A line that isn't JSON, or has another number than its place, becomes a record of that place without a checksum, so
    that ``sound`` stops there.
    """
    parts = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    lines = files.select(F.explode(F.transform(parts, lambda x, i: F.struct((F.col("first") + i).alias("at"), x.alias("line")))).alias("z"))
    read = lines.select("z.at", F.from_json("z.line", RECORD, {"mode": "PERMISSIVE"}).alias("r"))
    right = F.col("r.seq") == F.col("at")
    return read.select(F.col("at").alias("seq"), *(F.when(right, F.col(f"r.{c}")).alias(c) for c in ("op", "doc", "field", "term", "crc")))


def sound(log: DataFrame, after: int = -1) -> DataFrame:
    """Records behind ``after`` and before the first damaged one."""
    checked = log.where(F.col("seq") > after).withColumn("ok", record_crc() == F.col("crc"))
    bad = checked.where("NOT coalesce(ok, false)").agg(F.min("seq").alias("bad"))  # one row
    return checked.crossJoin(F.broadcast(bad)).where("bad IS NULL OR seq < bad").drop("ok", "bad")


def surviving(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """(seq, deleted) for every ADD of (seq, op, ...): a DELETE takes the documents with its term that were added before it.

    log: (seq, op, field, term), an ADD has a row for each of its indexed terms.
    """
    adds = log.where("op = 'ADD'").select("seq", "field", "term")
    last = log.where("op = 'DELETE'").groupBy("field", "term").agg(F.max("seq").alias("gone"))  # the last delete of a term decides
    hit = adds.join(last, ["field", "term"], "left").groupBy("seq").agg(F.coalesce(F.max(F.col("gone") > F.col("seq")), F.lit(False)).alias("deleted"))
    return hit


class DurableIndex:
    """An index in a folder of any Hadoop file system, with one writer at a time.

    Documents get their ids from their numbers in the log, so nothing has to be counted to number them.
    """

    def __init__(self, spark: SparkSession, path: str, spec: IndexSpec, schema: str) -> None:
        self.spark, self.path, self.spec, self.schema = spark, path, spec, schema
        self.folder = Folder(spark, path)
        self.folder.make("log")
        self.generation, self.segment, self.applied = 0, None, -1
        if self.folder.exists("CURRENT"):
            p = json.loads(self.folder.read("CURRENT"))
            self.generation, self.segment, self.applied = p["generation"], p["segment"], p["applied"]
        # mutations go on behind the last one that can be replayed; what is torn off is gone
        last = sound(self.log(), self.applied).agg(F.max("seq")).first()[0]
        self.next_seq = (self.applied if last is None else last) + 1
        self._cut()

    def log(self) -> DataFrame:
        files = self.spark.read.text(f"{self.path}/log", wholetext=True)
        name = F.col("_metadata.file_name")
        return log_records(files.select(F.regexp_extract(name, r"^(\d+)", 1).cast("long").alias("first"), F.col("value").alias("text")))

    def _cut(self) -> None:
        """Drop the log behind the last sound record, so that what is added next can be replayed."""
        for name in self.folder.names("log"):
            first = name.split(".")[0]
            if not first.isdigit():
                continue
            lines = self.folder.read(f"log/{name}").decode("utf-8", "replace").split("\n")
            if int(first) >= self.next_seq:
                self.folder.remove(f"log/{name}")
            elif int(first) + len(lines) - (not lines[-1]) > self.next_seq:
                self.folder.write(f"log/{name}", "".join(x + "\n" for x in lines[: self.next_seq - int(first)]).encode())

    def _append(self, records: list[dict]) -> None:
        lines = []
        for seq, r in enumerate(records, self.next_seq):
            whole = {"seq": seq, "op": r["op"]} | {k: r[k] for k in ("doc", "field", "term") if r.get(k) is not None}
            crc = zlib.crc32("\u0001".join([str(seq), *(whole.get(k, "") for k in ("op", "doc", "field", "term"))]).encode())
            lines.append(json.dumps(whole | {"crc": crc}, ensure_ascii=False))
        self.folder.write(f"log/{self.next_seq:020d}.json", "".join(x + "\n" for x in lines).encode())
        self.next_seq += len(records)

    def add_documents(self, docs: list[dict]) -> None:
        if docs:
            self._append([{"op": "ADD", "doc": json.dumps(d)} for d in docs])

    def delete_by_term(self, field: str, term: str) -> None:
        self._append([{"op": "DELETE", "field": field, "term": term}])

    def current(self) -> Index:
        """The committed generation with the log applied: uncommitted mutations are visible."""
        log = sound(self.log(), self.applied)
        adds = log.where("op = 'ADD'").select(F.col("seq").alias("doc_id"), F.from_json("doc", self.schema).alias("d")).select("doc_id", "d.*")
        fresh = build_index(adds, self.spec)
        base = read_segment(self.spark, f"{self.path}/{self.segment}", self.spec) if self.segment else None
        docs, postings, lengths = fresh.docs, fresh.postings, fresh.lengths
        if base is not None:
            docs, postings, lengths = base.docs.unionByName(docs, allowMissingColumns=True), base.postings.unionByName(postings), base.lengths.unionByName(lengths)
        last = log.where("op = 'DELETE'").groupBy("field", "term").agg(F.max("seq").alias("gone"))
        hit = postings.join(last, ["field", "term"]).where(F.col("gone") > F.col("doc_id")).select("doc_id")
        dead = hit if base is None else hit.union(base.deletes)
        return Index(docs, postings, lengths, dead.distinct(), self.spec)

    def commit(self) -> int:
        """A new generation; the pointer is swapped last, then the log it holds and the old generation go."""
        upto, old = self.next_seq - 1, self.segment
        segment = f"gen-{self.generation + 1:06d}-{uuid.uuid4().hex[:8]}"
        write_segment(self.current(), f"{self.path}/{segment}")
        self.folder.write("CURRENT", json.dumps({"generation": self.generation + 1, "segment": segment, "applied": upto}).encode())
        self.generation, self.segment, self.applied = self.generation + 1, segment, upto
        for name in self.folder.names("log"):
            self.folder.remove(f"log/{name}")
        if old:
            self.folder.remove(old)
        return self.generation
