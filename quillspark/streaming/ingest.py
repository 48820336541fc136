"""Mutations as a stream: every micro-batch of the log becomes index rows of one generation folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.index import Index, IndexSpec, build_index


def ingest(stream: DataFrame, spec: IndexSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Index a stream of mutations (op, doc_id, field, term, and a document's columns), in the order of ``doc_id``.

    ADD brings a document, DELETE takes those with its term that came before it.  A batch that runs again writes the same
    folders again.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        index = build_index(batch.where("op = 'ADD'").drop("op", "field", "term"), spec)
        for name in ("docs", "postings", "lengths"):
            getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}")
        batch.where("op = 'DELETE'").select("doc_id", "field", "term").write.mode("overwrite").parquet(f"{path}/removed/batch={epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str, spec: IndexSpec | None = None) -> Index:
    """What has been ingested so far; batches that come later don't change it."""
    t = {name: spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("docs", "postings", "lengths", "removed")}
    last = t["removed"].groupBy("field", "term").agg(F.max("doc_id").alias("gone"))
    dead = t["postings"].join(last, ["field", "term"]).where(F.col("gone") > F.col("doc_id")).select("doc_id").distinct()
    return Index(t["docs"], t["postings"], t["lengths"], dead, spec)
