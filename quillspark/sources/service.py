"""A service over a durable index: documents come and go, and searches see a snapshot that is made when one is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.functions.similarity import BM25, Similarity
from quillspark.operators.index import Index
from quillspark.operators.search import SearchService
from quillspark.sources.store import DurableIndex


class LiveService:
    """Mutations only mark the snapshot as old; the next search makes a new one, and those who hold the old one keep it."""

    def __init__(self, durable: DurableIndex, default_field: str, similarity: Similarity | None = None) -> None:
        self.durable, self.default_field, self.similarity = durable, default_field, similarity or BM25()
        self._snapshot: Index | None = None
        self.snapshots = 0

    def add(self, docs: list[dict]) -> None:
        self.durable.add_documents(docs)
        self._snapshot = None

    def delete(self, field: str, term: str) -> None:
        self.durable.delete_by_term(field, term)
        self._snapshot = None

    def commit(self) -> int:
        """The generation that now holds everything; the old one's files go, so snapshots of it end."""
        self._snapshot = None
        return self.durable.commit()

    def snapshot(self) -> Index:
        if self._snapshot is None:
            self._snapshot = self.durable.current()
            self.snapshots += 1
        return self._snapshot

    def search(self, text: str | None, in_field: str | None = None, k: int = 10) -> tuple[str, DataFrame, DataFrame]:
        return SearchService(self.snapshot(), self.default_field, self.similarity).search(text, in_field, k)

    def stats(self) -> DataFrame:
        return self.snapshot().stats()
