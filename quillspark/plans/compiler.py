"""From a query tree to one DataFrame plan.

The terms of all leaves are one filter on the postings (pushed to the scan of a stored index).  One aggregation by
document turns a document's postings into a match flag and a score for each distinct leaf, and the tree itself is an
expression over these, evaluated in the same stage: whatever the tree's shape, there is a single shuffle by document,
and no join between clauses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.similarity import BM25, Similarity
from quillspark.operators.index import Index
from quillspark.plans.query import BooleanQuery, MatchAllQuery, Occur, PhraseQuery, PrefixQuery, Query, TermQuery


def leaves(q: Query) -> list[Query]:
    if isinstance(q, BooleanQuery):
        return [x for c in q.clauses for x in leaves(c.query)]
    return [q]


def _simplified(q: Query) -> Query:
    if isinstance(q, PhraseQuery) and len(q.terms) == 1:
        return TermQuery(q.field, q.terms[0])
    if isinstance(q, BooleanQuery):
        return BooleanQuery(tuple(type(c)(_simplified(c.query), c.occur) for c in q.clauses), q.min_should)
    return q


def _selects(leaf: Query) -> Column:
    in_field = F.col("field") == leaf.field
    if isinstance(leaf, TermQuery):
        return in_field & (F.col("term") == leaf.term)
    if isinstance(leaf, PhraseQuery):
        return in_field & F.col("term").isin(sorted(set(leaf.terms)))
    return in_field & F.col("term").startswith(leaf.prefix)


def term_weights(index: Index, df: DataFrame, similarity: Similarity) -> DataFrame:
    """(field, term, idf, avg_len) of (field, term, df); df counts deleted documents, N doesn't."""
    n = index.stats().select(F.greatest("num_docs", F.lit(1)).alias("n"))  # one row
    per_field = index.field_stats().select("field", "avg_len")  # a row for each field of the schema
    known = df.join(F.broadcast(per_field), "field", "left").crossJoin(F.broadcast(n))
    return known.select("field", "term", similarity.idf(F.col("df"), F.col("n")).alias("idf"), F.coalesce("avg_len", F.lit(0.0)).alias("avg_len"))


def scored_postings(index: Index, rows: DataFrame, similarity: Similarity, few_terms: bool = False, selects: Column | None = None) -> DataFrame:
    """``rows`` of live documents with idf, avg_len and score; ``selects`` is what chose their terms, if that is known.

    ``few_terms``: the rows are of terms that a query lists, so the table of their frequencies has no more rows than
    that and is broadcast; otherwise (prefixes) the planner decides by its size.
    """
    if index.terms_table is not None:
        df = index.dictionary().select("field", "term", "df")
        df = df.where(selects) if selects is not None else df
    else:
        df = rows.groupBy("field", "term").agg(F.count("*").alias("df"))
    weights = term_weights(index, df, similarity)
    known = index.live(rows).join(F.broadcast(weights) if few_terms and selects is not None else weights, ["field", "term"])
    return known.withColumn("score", similarity.score(F.col("tf"), F.col("idf"), F.col("len"), F.col("avg_len")))


def compile_query(q: Query, index: Index, similarity: Similarity | None = None) -> DataFrame:
    """(doc_id, score), each matching live document once."""
    similarity = similarity or BM25()
    q = _simplified(q)
    spark = index.postings.sparkSession
    empty = spark.createDataFrame([], "doc_id long, score double")
    if isinstance(q, MatchAllQuery):
        return index.live(index.docs.select(F.col("doc_id").cast("long").alias("doc_id"))).select("doc_id", F.lit(float(q.boost)).alias("score"))
    distinct = list(dict.fromkeys(leaves(q)))
    textual = [x for x in distinct if not isinstance(x, MatchAllQuery)]
    if not distinct or not _can_match(q):
        return empty
    if textual:
        selects = reduce(lambda a, b: a | b, map(_selects, textual))
        rows = index.postings.where(selects)
        if not any(isinstance(x, PhraseQuery) for x in textual):
            rows = rows.drop("positions")
        aggregated, finish = _leaf_columns(textual, similarity)
        few = not any(isinstance(x, PrefixQuery) for x in textual)
        by_doc = scored_postings(index, rows, similarity, few, selects).groupBy("doc_id").agg(*aggregated).select("doc_id", *finish)
    else:
        by_doc = spark.createDataFrame([], "doc_id long")
    if len(textual) < len(distinct):  # a clause matches all: start from the live documents
        by_doc = index.live(index.docs.select(F.col("doc_id").cast("long").alias("doc_id"))).join(by_doc, "doc_id", "left")
    place = {leaf: i for i, leaf in enumerate(textual)}
    match, score = _evaluate(q, place)
    return by_doc.where(match).select("doc_id", score.alias("score"))


def _leaf_columns(textual: list[Query], similarity: Similarity) -> tuple[list[Column], list[Column]]:
    """Aggregates by document, and s<i>: the score of leaf i, null where it doesn't match."""
    aggregated, finish = [], []
    for i, leaf in enumerate(textual):
        if not isinstance(leaf, PhraseQuery):
            aggregated.append(F.sum(F.when(_selects(leaf), F.col("score"))).alias(f"s{i}"))
            finish.append(F.col(f"s{i}"))
            continue
        terms = sorted(set(leaf.terms))
        for j, term in enumerate(terms):
            this = (F.col("field") == leaf.field) & (F.col("term") == term)
            aggregated.append(F.first(F.when(this, F.struct("positions", "idf")), ignorenulls=True).alias(f"p{i}_{j}"))
        aggregated.append(F.first(F.when(F.col("field") == leaf.field, F.struct("len", "avg_len")), ignorenulls=True).alias(f"p{i}"))
        starts = [F.transform(F.col(f"p{i}_{terms.index(t)}.positions"), _minus(k)) for k, t in enumerate(leaf.terms)]
        freq = F.size(reduce(F.array_intersect, starts))
        idf = reduce(lambda a, b: a + b, [F.col(f"p{i}_{terms.index(t)}.idf") for t in leaf.terms])
        s = similarity.score(freq, idf, F.col(f"p{i}.len"), F.coalesce(F.col(f"p{i}.avg_len"), F.lit(0.0)))
        finish.append(F.when(freq > 0, s).alias(f"s{i}"))
    return aggregated, finish


def _minus(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def _can_match(q: Query) -> bool:
    if not isinstance(q, BooleanQuery):
        return True
    must, should = q.of(Occur.MUST), q.of(Occur.SHOULD)
    if must:
        return all(map(_can_match, must))
    return sum(map(_can_match, should)) >= max(1, q.min_should)


def _evaluate(q: Query, place: dict[Query, int]) -> tuple[Column, Column]:
    """(matches, score); the score counts only where it matches."""
    if isinstance(q, MatchAllQuery):
        return F.lit(True), F.lit(float(q.boost))
    if not isinstance(q, BooleanQuery):
        s = F.col(f"s{place[q]}")
        return s.isNotNull(), s
    parts = {o: [_evaluate(x, place) for x in q.of(o)] for o in Occur}
    must, should, never = parts[Occur.MUST], parts[Occur.SHOULD], parts[Occur.MUST_NOT]
    if not must and not should:
        return F.lit(False), F.lit(0.0)
    optional = [F.when(m, s).otherwise(0.0) for m, s in should]
    if must:
        match = reduce(lambda a, b: a & b, [m for m, _ in must])
        total = [s for _, s in must] + optional
    else:
        match = reduce(lambda a, b: a + b, [m.cast("int") for m, _ in should]) >= max(1, q.min_should)
        total = optional
    if never:
        match = match & ~reduce(lambda a, b: a | b, [m for m, _ in never])
    return match, reduce(lambda a, b: a + b, total)
