"""Logs, generations, streams: what is left after damage, restarts and late changes."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators.index import FieldType, IndexSpec
from quillspark.operators.search import Searcher
from quillspark.plans.query import TermQuery
from quillspark.sources import store
from quillspark.sources.folders import Folder, scratch, shared_folder
from quillspark.sources.service import LiveService
from quillspark.streaming import events, ingest

SPEC = IndexSpec({"id": FieldType.KEYWORD, "body": FieldType.TEXT})


def opened(spark, path):
    return store.DurableIndex(spark, path, SPEC, "id string, body string")


def ids(index, word="fox"):
    hits = Searcher(index).matches(TermQuery("body", word)).join(index.docs, "doc_id")
    return sorted(r.id for r in hits.collect())


def test_replay_stops_at_the_first_torn_record(spark):
    path = scratch(spark)
    ix = opened(spark, path)
    ix.add_documents([{"id": f"d{i}", "body": "a fox"} for i in range(4)])
    ix.add_documents([{"id": "d4", "body": "a fox"}])
    folder = Folder(spark, path)
    name = folder.names("log")[0]
    lines = folder.read(f"log/{name}").decode().split("\n")
    lines[1] = lines[1][: len(lines[1]) // 2]
    folder.write(f"log/{name}", "\n".join(lines).encode())
    again = opened(spark, path)
    assert ids(again.current()) == ["d0"]
    again.add_documents([{"id": "new", "body": "red fox"}])  # goes on where the log is sound
    assert ids(opened(spark, path).current()) == ["d0", "new"]


def test_log_ends_within_a_line(spark):
    path = scratch(spark)
    opened(spark, path).add_documents([{"id": f"d{i}", "body": "a fox"} for i in range(3)])
    folder = Folder(spark, path)
    name = folder.names("log")[0]
    data = folder.read(f"log/{name}")
    folder.write(f"log/{name}", data[:-9])
    assert ids(opened(spark, path).current()) == ["d0", "d1"]


def test_deletes_commits_and_reopening(spark):
    path = scratch(spark)
    ix = opened(spark, path)
    ix.add_documents([{"id": f"d{i}", "body": "a fox"} for i in range(3)])
    before = ix.current()
    ix.delete_by_term("id", "d1")
    assert ids(before) == ["d0", "d1", "d2"]  # a snapshot stays as it was
    ix.commit()
    ix.add_documents([{"id": "d1", "body": "a fox again"}])
    assert ids(opened(spark, path).current()) == ["d0", "d1", "d2"]
    ix.delete_by_term("body", "fox")
    ix.commit()
    assert ids(opened(spark, path).current()) == []
    assert [n for n in Folder(spark, path).names("") if n.startswith("gen-")] == [ix.segment]
    assert json.loads(Folder(spark, path).read("CURRENT"))["applied"] == ix.next_seq - 1


def test_damaged_segments_dont_open(spark):
    path = scratch(spark)
    store.build_segment(spark.createDataFrame([(0, "d0", "a fox")], "doc_id long, id string, body string"), SPEC, path)
    assert ids(store.read_segment(spark, path, SPEC, verify=True)) == ["d0"]
    folder = Folder(spark, path)
    name = next(n for n in folder.names("docs") if n.endswith(".parquet"))
    folder.remove(f"docs/{name}")
    with pytest.raises(OSError, match="damaged"):
        store.read_segment(spark, path, SPEC, verify=True)


def test_stored_statistics_equal_counted_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("body"), F.col("source").alias("id"))
    stored = store.build_segment(docs, SPEC, scratch(spark))
    counted = store.Index(stored.docs, stored.postings, stored.lengths, stored.deletes, SPEC)
    for a, b in ((stored.dictionary(), counted.dictionary()), (stored.field_stats(), counted.field_stats())):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    q = TermQuery("body", "thin")
    assert sorted(map(tuple, Searcher(stored).matches(q).collect())) == sorted(map(tuple, Searcher(counted).matches(q).collect()))


def test_snapshots_are_made_when_asked_for(spark):
    service = LiveService(opened(spark, scratch(spark)), "body")
    service.add([{"id": "a", "body": "fox"}])
    service.add([{"id": "b", "body": "fox"}])
    assert service.snapshots == 0
    assert [service.search("fox")[1].first()[0] for _ in range(2)] == [2, 2]
    assert (service.snapshots, service.stats().first().num_docs) == (1, 2)


def test_ingestion_with_deletes(spark):
    path, source = scratch(spark), scratch(spark)
    schema = "doc_id long, op string, id string, body string, field string, term string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    go = lambda: ingest.ingest(spark.readStream.schema(schema).json(source), SPEC, path, f"{path}/checkpoint").awaitTermination(120)
    write([(0, "ADD", "d0", "a fox", None, None), (1, "ADD", "d1", "a fox", None, None), (2, "DELETE", None, None, "id", "d0")])
    go()
    first = ingest.snapshot(spark, path, SPEC)
    assert ids(first) == ["d1"]
    write([(3, "ADD", "d0", "new fox", None, None), (4, "DELETE", None, None, "id", "d1")])
    go()
    assert ids(ingest.snapshot(spark, path, SPEC)) == ["d0"]


def allowed(times, most, window):
    out, begin, n = [], None, 0
    for t in times:
        if begin is None or t - begin >= window:
            begin, n = t, 0
        n += 1
        out.append(n <= most)
    return out


def test_limiter_by_batch_and_by_stream(spark):
    rows = [(u, (u * 7919 + i * i * 37 + i * 11) % 5000, i) for u in range(5) for i in range(300 if u == 2 else 20)]
    df = spark.createDataFrame(rows, "user long, s long, req long").select("user", F.timestamp_seconds("s").alias("ts"), "req")
    want = {}
    for u in range(5):
        mine = sorted((s, i) for v, s, i in rows if v == u)
        want |= {(u, i): ok for (_, i), ok in zip(mine, allowed([s for s, _ in mine], 3, 60), strict=True)}
    assert {(r.user, r.req): r.allowed for r in events.rate_limited(df.repartition(3), "user", "ts", "req", 3, 60_000_000).collect()} == want
    assert all(r.allowed for r in events.rate_limited(df, "user", "ts", "req", 0, 60_000_000).collect())
    source, out = scratch(spark), scratch(spark)
    df.coalesce(1).write.parquet(source)
    stream = events.rate_limited_stream(spark.readStream.schema(df.schema).parquet(source), "user", "ts", "req", 3, 60_000_000)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.user, r.req): r.allowed for r in spark.read.parquet(out).collect()} == want


def test_percentiles_of_skewed_values(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise((F.col("id") * 7919 % 10_007).cast("double")).alias("v"))
    rows = rows.union(spark.createDataFrame([("one", 5.0), ("nulls", None), (None, 2.0)], "k string, v double"))
    by = {}
    for r in rows.collect():
        if r.v is not None:
            by.setdefault(r.k, []).append(r.v)
    ps = [0.0, 0.5, 0.95, 0.99, 1.0]
    want = {(k, p): sorted(v)[int(p * (len(v) - 1) + 0.5)] for k, v in by.items() for p in ps}
    assert {(r.k, r.p): r.v for r in events.nearest_ranks(rows, "k", "v", ps).collect()} == want


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class Session:
        sparkContext = Elsewhere()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="shared|share"):
        shared_folder(Session())
