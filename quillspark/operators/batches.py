"""Many queries at once: the postings that they ask for, brought together by document, and the best of each chunk of documents.

A posting moves once, however many queries want it.  Sorted by document they are taken in chunks of ``DOCS`` documents or
``POSTINGS`` postings; each query adds up its postings in an array with a place for each document of the chunk, and only its
best rows leave the chunk, so neither rows nor memory grow with queries times documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillspark.operators.documents import prepare

DOCS, POSTINGS = 16_384, 2_000_000
#: Rows (query, field, term) that the driver and each task hold; more are joined instead.
MOST = 2_000_000
#: Scores that differ by less may be equal when they are rounded.
SLACK = 4e-9
_NULL = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Asked:
    """Queries as sparse rows over slots, which are the distinct (field, term)."""

    ids: pa.Array
    begins: np.ndarray
    slot: np.ndarray
    times: np.ndarray
    terms: pa.Table

    @classmethod
    def of(cls, asked: pa.Table) -> Asked:
        """``asked``: distinct (query_id, field, term) with the times they stand in the query."""
        pair = asked.select(["field", "term"]).combine_chunks()
        terms = pair.group_by(["field", "term"]).aggregate([])
        terms = terms.append_column("slot", pa.array(np.arange(terms.num_rows), pa.int32()))
        place = {(f, t): i for i, (f, t) in enumerate(zip(terms["field"].to_pylist(), terms["term"].to_pylist(), strict=True))}
        slot = np.fromiter((place[x] for x in zip(pair["field"].to_pylist(), pair["term"].to_pylist(), strict=True)), np.int64, pair.num_rows)
        coded = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        query = coded.indices.to_numpy()
        order = np.lexsort((slot, query))
        begins = np.searchsorted(query[order], np.arange(len(coded.dictionary) + 1))
        return cls(coded.dictionary, begins, slot[order], asked.column("times").to_numpy()[order], terms)

    def slots(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.terms)


@dataclass(frozen=True)
class Chunk:
    """Postings of some documents, sorted by slot: the document's place in ``doc``, and other values by name."""

    doc: np.ndarray
    slot: np.ndarray
    owner: np.ndarray
    values: dict[str, np.ndarray]

    def best(self, asked: Asked, weight: np.ndarray, k: int, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the k best and those that rounding or a larger id may put beside them.

        A score is the sum of ``weight`` over the query's postings, or, if given, the document's value in ``whole``.
        """
        m = len(self.doc)
        edge = np.searchsorted(self.slot, np.arange(asked.terms.num_rows + 1))
        out: list[tuple[np.ndarray, ...]] = []
        for q in range(len(asked.ids)):
            a, z = asked.begins[q], asked.begins[q + 1]
            mine = [(edge[s], edge[s + 1], n) for s, n in zip(asked.slot[a:z].tolist(), asked.times[a:z].tolist(), strict=True) if edge[s + 1] > edge[s]]
            if not mine:
                continue
            to = np.concatenate([self.owner[x:y] for x, y, _ in mine])
            hit = np.flatnonzero(np.bincount(to, minlength=m))
            score = whole[hit] if whole is not None else np.bincount(to, np.concatenate([weight[x:y] * n for x, y, n in mine]), m)[hit]
            if len(hit) > k:
                least = np.partition(score, len(hit) - k)[len(hit) - k] - SLACK
                hit, score = hit[score >= least], score[score >= least]
                order = np.lexsort((self.doc[hit], -score))
                hit, score = hit[order], score[order]
                first = np.flatnonzero(np.diff(score, prepend=np.nan) != 0)  # of equal scores, the k smaller ids
                kept = np.arange(len(hit)) - np.repeat(first, np.diff(np.r_[first, len(hit)])) < k
                hit, score = hit[kept], score[kept]
            out.append((np.full(len(hit), q), hit, score))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of (doc_id, slot, ...) that are sorted by ``doc_id``; a document is in one chunk."""

    def made(t: pa.Table) -> Chunk:
        ids = _ids(t)
        new = _starts(ids)
        slot = t.column("slot").to_numpy().astype(np.int64)
        order = np.argsort(slot, kind="stable")
        values = {c: t.column(c).to_numpy()[order] for c in t.column_names[2:]}
        return Chunk(ids[new], slot[order], (np.cumsum(new) - 1)[order], values)

    held: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        docs, postings = docs + int(_starts(_ids(batch)).sum()), postings + batch.num_rows
        if docs >= DOCS or postings >= POSTINGS:  # the last document may go on
            t = pa.Table.from_batches(held).combine_chunks()
            if cut := int(np.flatnonzero(_starts(_ids(t)))[-1]):
                yield made(t.slice(0, cut))
                held, docs, postings = t.slice(cut).to_batches(), 1, t.num_rows - cut
    if held:
        yield made(pa.Table.from_batches(held))


def _starts(ids: np.ndarray) -> np.ndarray:
    return np.diff(ids, prepend=~ids[:1]) != 0


def _ids(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(t.column("doc_id"), int(_NULL)).to_numpy()


def by_document(rows: DataFrame) -> DataFrame:
    return rows.repartition("doc_id").sortWithinPartitions("doc_id")


def best(rows: DataFrame, asked: Asked, k: int, of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[Chunk, np.ndarray | None, np.ndarray | None]]]) -> DataFrame:
    """(query_id, doc_id, score): the best k of every chunk that ``of`` makes of ``rows``, each with its weights (or whole values)."""
    shared = prepare(rows.sparkSession).sparkContext.broadcast(asked)
    out = StructType([StructField("query_id", from_arrow_type(asked.ids.type)), StructField("doc_id", LongType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, weight, whole in of(batches):
            query, place, score = chunk.best(shared.value, weight, k, whole)
            ids = chunk.doc[place]
            yield pa.RecordBatch.from_arrays([shared.value.ids.take(pa.array(query)), pa.array(ids, mask=ids == _NULL), pa.array(score)], ["query_id", "doc_id", "score"])

    return rows.mapInArrow(run, out)
