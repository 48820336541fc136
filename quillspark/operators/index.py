"""An inverted index as DataFrames.

    postings (field, term, doc_id, tf, positions, len)   len: the document's field length, so that scoring needs no join
    lengths  (doc_id, field, len)
    docs     the stored rows, with doc_id
    deletes  (doc_id)

Document frequencies, totals and averages include deleted documents, as soft deletes leave postings alone; N does
not.  A field counts for a document only with at least one surviving token.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.analysis import Analyzer, KeywordAnalyzer, field_terms, single_terms

DELETES = "doc_id long"
POSTINGS = "field string, term string, doc_id long, tf int, positions array<int>, len int"


class FieldType(Enum):
    TEXT = "text"
    KEYWORD = "keyword"
    STORED = "stored"


@dataclass(frozen=True)
class IndexSpec:
    """Fields by column name; a boost is kept but doesn't score."""

    fields: dict[str, FieldType]
    analyzer: Analyzer = field(default_factory=Analyzer)
    boosts: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, b in self.boosts.items():
            if not 0 < b < float("inf"):
                raise ValueError(f"boost of {name} must be positive and finite")

    def analyzer_of(self, name: str) -> Analyzer | KeywordAnalyzer:
        return KeywordAnalyzer() if self.fields[name] is FieldType.KEYWORD else self.analyzer


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    deletes: DataFrame | None = None
    spec: IndexSpec | None = None
    #: Written with a stored index; counted otherwise.
    terms_table: DataFrame | None = None
    stats_table: DataFrame | None = None

    # ---- statistics
    def dictionary(self) -> DataFrame:
        """(field, term, df, ttf)."""
        if self.terms_table is not None:
            return self.terms_table.select("field", "term", "df", "ttf")
        return self.postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))

    def field_stats(self) -> DataFrame:
        """(field, total_len, doc_count, avg_len)."""
        return self.stats_table if self.stats_table is not None else self.measured_fields()

    def measured_fields(self) -> DataFrame:
        return self.lengths.where("len > 0").groupBy("field").agg(F.sum("len").alias("total_len"), F.count("*").alias("doc_count"), F.avg("len").alias("avg_len"))

    def stats(self) -> DataFrame:
        """One row (num_docs, max_doc, num_deleted)."""
        dead = self.deletes.distinct().agg(F.count("*").alias("num_deleted")) if self.deletes is not None else self.docs.sparkSession.sql("SELECT 0L AS num_deleted")
        return self.docs.agg(F.count("*").alias("max_doc")).crossJoin(dead).select((F.col("max_doc") - F.col("num_deleted")).alias("num_docs"), "max_doc", "num_deleted")

    def field_names(self) -> DataFrame:
        return self.dictionary().select("field").distinct()

    def terms(self, name: str) -> DataFrame:
        return self.dictionary().where(F.col("field") == name).select("term")

    def only(self, fields: list[str]) -> Index:
        """The index of some of its fields; everything about the others is left unread."""
        some = F.col("field").isin(fields)
        pick = lambda t: None if t is None else t.where(some)
        return replace(self, postings=pick(self.postings), lengths=pick(self.lengths), terms_table=pick(self.terms_table), stats_table=pick(self.stats_table))

    def doc_frequency(self, name: str, term: str) -> DataFrame:
        return self.posting_list(name, term).agg(F.count("*").alias("df"))

    def posting_list(self, name: str, term: str) -> DataFrame:
        return self.postings.where((F.col("field") == name) & (F.col("term") == term))

    def document(self, doc_id: int) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def is_deleted(self, doc_id: int) -> bool:
        return self.deletes is not None and not self.deletes.where(F.col("doc_id") == doc_id).isEmpty()

    def live(self, df: DataFrame) -> DataFrame:
        return df if self.deletes is None else df.join(self.deletes, "doc_id", "left_anti")

    # ---- changes
    def delete_by_term(self, name: str, term: str) -> Index:
        """Soft-delete the documents with the verbatim index term."""
        return self._deleting(self.posting_list(name, term).select("doc_id"))

    def delete_document(self, doc_id: int) -> Index:
        """Idempotent; the id must exist."""
        if not self.document(doc_id).take(1):
            raise IndexError(f"no document {doc_id}")
        return self._deleting(self.document(doc_id).select("doc_id"))

    def newly_deleted(self, name: str, term: str) -> DataFrame:
        return self.live(self.posting_list(name, term).select("doc_id"))

    def _deleting(self, ids: DataFrame) -> Index:
        return replace(self, deletes=ids.distinct() if self.deletes is None else self.deletes.union(ids).distinct())

    def add(self, rows: DataFrame) -> Index:
        """Append documents; an id that exists already makes a second document only if ids differ, as nothing is replaced."""
        more = build_index(rows, self.spec)
        return replace(self, docs=self.docs.unionByName(more.docs, allowMissingColumns=True), postings=self.postings.unionByName(more.postings), lengths=self.lengths.unionByName(more.lengths), terms_table=None, stats_table=None)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense ids from 0 in the given order, without one task that sorts everything.

    Rows are sorted by range; a partition's ids start behind the counts of those before it, which are one number for each.
    """
    ranged = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    w = Window.partitionBy("part_").orderBy(*order)
    placed = ranged.withColumn("place_", F.row_number().over(w))
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part_", before.alias("base_"))
    return placed.join(F.broadcast(base), "part_").withColumn("doc_id", F.col("base_") + F.col("place_") - 1).drop("part_", "place_", "base_")


def analyzed(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """(doc_id, field, found, len) of rows with a ``doc_id``.  A column of arrays is a field with several values."""
    entries = []
    for name in (n for n, t in spec.fields.items() if t is not FieldType.STORED):
        c = F.col(name)
        many = isinstance(df.schema[name].dataType, T.ArrayType)
        found = field_terms(c.cast("array<string>"), spec.analyzer_of(name)) if many else single_terms(c.cast("string"), spec.analyzer_of(name))
        entries.append(F.struct(F.lit(name).alias("field"), found.alias("found")))
    per_field = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(*entries)).alias("e")).select("doc_id", "e.field", "e.found")
    return per_field.withColumn("len", F.size("found"))


def postings_of(rows: DataFrame) -> DataFrame:
    """Postings of analyzed rows; partial aggregation happens where the document is, so postings are shuffled, not tokens."""
    each = rows.select("field", "doc_id", "len", F.explode("found").alias("x"))
    return each.groupBy("field", F.col("x.term").alias("term"), "doc_id").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("x.pos")).alias("positions"), F.first("len").alias("len"))


def build_index(df: DataFrame, spec: IndexSpec) -> Index:
    """Index rows with a ``doc_id``, without writing anything."""
    rows = analyzed(df, spec)
    stored = df if not spec.boosts else df.withColumn("boosts", F.create_map(*[F.lit(x) for kv in spec.boosts.items() for x in kv]))
    return Index(stored, postings_of(rows), rows.select("doc_id", "field", "len"), None, spec)
