"""Searching an index: single queries, and many at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.similarity import BM25, Similarity
from quillspark.operators import batches
from quillspark.operators.index import Index
from quillspark.plans.compiler import compile_query, term_weights
from quillspark.plans.parser import QueryParser
from quillspark.plans.query import MatchAllQuery, Query

#: Decimals of a score that order hits; beyond it, the order of additions would decide.
DIGITS = 9
MAX_QUERY, MAX_K = 2048, 1000


@dataclass(frozen=True)
class Searcher:
    index: Index
    similarity: Similarity = field(default_factory=BM25)

    def matches(self, query: Query) -> DataFrame:
        """(doc_id, score) of all hits, unordered."""
        return compile_query(query, self.index, self.similarity)

    def search(self, query: Query, k: int = 10) -> DataFrame:
        """(doc_id, score) of the k best, by score and then id; k is at least 1."""
        return self.matches(query).orderBy(F.round("score", DIGITS).desc(), "doc_id").limit(max(1, k))

    def total_hits(self, query: Query) -> DataFrame:
        return self.matches(query).agg(F.count("*").alias("total_hits"))

    def hits(self, query: Query, k: int = 10, columns: list[str] | None = None) -> DataFrame:
        """The k best with their rank and stored columns, as one JSON value each."""
        top = self.search(query, k)
        stored = [c for c in (columns or self.index.docs.columns) if c != "doc_id"]
        first = [F.element_at(F.col(c), 1).alias(c) if self.index.docs.schema[c].dataType.typeName() == "array" else F.col(c) for c in stored]
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", DIGITS).desc(), "doc_id")))
        docs = self.index.docs.select(F.col("doc_id").cast("long").alias("doc_id"), *first)
        return docs.join(F.broadcast(ranked) if k <= MAX_K else ranked, "doc_id").select("rank", "doc_id", "score", F.to_json(F.struct(*stored)).alias("fields"))

    def batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k best for every query of (query_id, field, term), a row for each term: terms are optional, and repeated ones count again.

        The queries' terms get their weights first.  The postings that any query wants are scored once and brought together by
        document; each chunk of documents gives the best of every query.
        """
        counted = queries.groupBy("query_id", "field", "term").agg(F.count("*").alias("times")).where("field IS NOT NULL AND term IS NOT NULL")
        few = counted.limit(batches.MOST + 1).toArrow()
        if not few.num_rows:
            return _best(queries.sparkSession.createDataFrame([], StructType([queries.schema["query_id"], *StructType.fromDDL("doc_id long, score double").fields])), k)
        if few.num_rows > batches.MOST:
            scored = self._asked(counted, positions=False)
            return _best(scored.groupBy("query_id", "doc_id").agg(F.sum(F.col("score") * F.col("times")).alias("score")), k)
        asked = batches.Asked.of(few)
        scored = self.slotted(asked).withColumn("score", self.similarity.score(F.col("tf"), F.col("idf"), F.col("len"), F.col("avg_len")).cast("double"))
        return _best(batches.best(batches.by_document(scored.select("doc_id", "slot", "score")), asked, max(1, k), _summed), k)

    def slotted(self, asked: batches.Asked) -> DataFrame:
        """Postings of live documents that any query wants: (doc_id, slot, tf, len, idf, avg_len)."""
        ix = self.index
        slots = F.broadcast(asked.slots(ix.postings.sparkSession))
        weights = term_weights(ix, ix.dictionary().select("field", "term", "df").join(slots, ["field", "term"], "left_semi"), self.similarity)
        known = slots.join(weights, ["field", "term"])
        return ix.live(ix.postings.drop("positions")).join(F.broadcast(known), ["field", "term"]).select("doc_id", "slot", "tf", "len", "idf", "avg_len")

    def batch_pairs(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k best for every query of (query_id, kind, field, a, b): kind 'term' is a alone, 'and' both, 'phrase' b right behind a.

        Terms stand as they are in the index.  Positions are read for phrases only.
        """
        one, both = F.array(F.struct(F.lit(0).alias("slot"), F.col("a").alias("term"))), F.array(F.struct(F.lit(0).alias("slot"), F.col("a").alias("term")), F.struct(F.lit(1).alias("slot"), F.col("b").alias("term")))
        asked = queries.select("query_id", "kind", "field", F.explode(F.when(F.col("kind") == "term", one).otherwise(both)).alias("x")).select("query_id", "kind", "field", "x.slot", "x.term")
        phrase = F.col("kind") == "phrase"
        sums = self._asked(asked.where(~phrase), positions=False).groupBy("query_id", "kind", "doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("slots"))
        whole = sums.where("kind = 'term' OR slots = 2").select("query_id", "doc_id", "score")
        at = lambda i: F.first(F.when(F.col("slot") == i, F.col("positions")), ignorenulls=True)
        pairs = self._asked(asked.where(phrase), positions=True).groupBy("query_id", "doc_id").agg(F.sum("idf").alias("idf"), F.first("len").alias("len"), F.first("avg_len").alias("avg_len"), at(0).alias("p"), at(1).alias("q"))
        freq = F.size(F.array_intersect("p", F.transform("q", lambda x: x - 1)))
        adjacent = pairs.where(freq > 0).select("query_id", "doc_id", self.similarity.score(freq, F.col("idf"), F.col("len"), F.col("avg_len")).alias("score"))
        return _best(whole.unionByName(adjacent), k)

    def _asked(self, asked: DataFrame, positions: bool) -> DataFrame:
        """Postings of live documents with the rows of ``asked`` (field, term, ...) that want them, idf, avg_len and score."""
        ix = self.index
        df = ix.dictionary().select("field", "term", "df").join(asked.select("field", "term").distinct(), ["field", "term"], "left_semi")
        weighted = asked.join(term_weights(ix, df, self.similarity), ["field", "term"])
        rows = ix.postings if positions else ix.postings.drop("positions")
        return ix.live(rows).join(weighted, ["field", "term"]).withColumn("score", self.similarity.score(F.col("tf"), F.col("idf"), F.col("len"), F.col("avg_len")))


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[batches.Chunk, np.ndarray, None]]:
    for chunk in batches.chunks(rows):
        yield chunk, chunk.values["score"], None


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= max(1, k)).select("query_id", "rank", "doc_id", "score")


@dataclass(frozen=True)
class SearchService:
    """What a search request does: a blank query matches all, k is limited, and the answer has totals and hits."""

    index: Index
    default_field: str
    similarity: Similarity = field(default_factory=BM25)

    def query(self, text: str | None, in_field: str | None = None) -> Query:
        if text is not None and len(text) > MAX_QUERY:
            raise ValueError(f"a query has at most {MAX_QUERY} characters")
        if text is None or not text.strip():
            return MatchAllQuery()
        return QueryParser(in_field or self.default_field, self.index.spec.analyzer).parse(text)

    def search(self, text: str | None, in_field: str | None = None, k: int = 10) -> tuple[str, DataFrame, DataFrame]:
        """(canonical query, one row with the total, hits)."""
        q = self.query(text, in_field)
        s = Searcher(self.index, self.similarity)
        return str(q), s.total_hits(q), s.hits(q, min(max(k, 1), MAX_K))

    def stats(self) -> DataFrame:
        return self.index.stats()
