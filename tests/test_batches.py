"""Batches of queries by chunks of documents, against joining postings with queries."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions.similarity import BM25, TfIdf
from quillspark.operators import batches
from quillspark.operators.index import FieldType, IndexSpec, build_index
from quillspark.operators.search import Searcher

TEXTS = ["fox dog cat", "fox fox", None, "dog", "owl", "fox dog"] * 9 + ["fox dog cat owl"]
ASKED = [(1, "fox"), (1, "fox"), (1, "dog"), (2, "owl"), (3, "nothing"), (None, "cat"), (4, "fox"), (4, "owl"), (4, "dog"), (4, "cat"), (5, None)]


@pytest.fixture(scope="module")
def searched(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, body string").repartition(3)
    queries = spark.createDataFrame([(q, "body", t) for q, t in ASKED], "query_id int, field string, term string")
    return build_index(docs, IndexSpec({"body": FieldType.TEXT})).delete_document(1), queries


@pytest.mark.parametrize(("size", "most"), [(1, 100), (3, 100), (1 << 20, 100), (1, 2)])
@pytest.mark.parametrize("similarity", [BM25(), TfIdf()])
def test_the_best_of_each_query(searched, monkeypatch, size, most, similarity):
    """Most scores are tied; those of equal score go by id, in chunks of any size and where queries are joined."""
    index, queries = searched
    scores = defaultdict(float)
    one = Searcher(index, similarity)
    for q, t in ASKED:
        for r in index.live(index.postings.where(F.col("term") == t)).select("doc_id").collect():
            scores[q, r.doc_id] += 0.0
    for r in one._asked(queries.groupBy("query_id", "field", "term").agg(F.count("*").alias("times")), positions=False).collect():
        scores[r.query_id, r.doc_id] += r.score * r.times
    want = {q: sorted(((-round(s, 9), d) for (p, d), s in scores.items() if p == q))[:4] for q, _ in ASKED}
    monkeypatch.setattr(batches, "DOCS", size)
    monkeypatch.setattr(batches, "MOST", most)
    got = defaultdict(list)
    for r in one.batch(queries, 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 9), r.doc_id))
    assert dict(got) == {q: w for q, w in want.items() if w}


def test_no_queries(searched):
    index, queries = searched
    assert Searcher(index).batch(queries.where("false")).collect() == []


def test_rows_that_leave_a_chunk_are_bounded(spark, searched):
    """Every pair of query and document was shuffled before."""
    index, queries = searched
    made = Searcher(index).batch(queries, 2)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    one = batches.Asked.of(queries.where("term = 'fox' AND query_id = 4").groupBy("query_id", "field", "term").agg(F.count("*").alias("times")).toArrow())
    rows = spark.createDataFrame([(i, 0, 1.0) for i in range(1000)], "doc_id long, slot int, score double").coalesce(1)

    def of(some):
        for c in batches.chunks(some):
            yield c, c.values["score"], None

    assert sorted(r.doc_id for r in batches.best(rows, one, 2, of).collect()) == [0, 1]


def test_trials_of_tuning_move_no_pairs(spark, sf, monkeypatch):
    """Each trial grouped all pairs of query and labelled document before; the result is that of grouping them."""
    from quillspark.catalog import misc, search
    from quillspark.functions.analysis import Analyzer

    ranked, best = [], batches.best
    monkeypatch.setattr(batches, "best", lambda rows, *more: ranked.append(rows) or best(rows, *more))
    ix, labels = search.corpus(spark, sf), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("gain"))
    got = misc.tune_bm25(spark, sf).first()
    terms = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.lit("body").alias("field"), F.explode(F.array_distinct(Analyzer().terms(F.col("text")))).alias("term"))
    pairs = Searcher(ix, BM25(got.k1, got.b))._asked(terms, positions=False).join(labels, "doc_id").groupBy("query_id", "doc_id").agg(F.sum("score").alias("s"), F.first("gain").alias("g")).collect()
    by = defaultdict(list)
    for r in pairs:
        by[r.query_id].append(r)
    gain = lambda rows: sum(r.g / math.log2(i + 2) for i, r in enumerate(rows[:10]))
    each = [(gain(sorted(rows, key=lambda r: (-round(r.s, 9), r.doc_id))), gain(sorted(rows, key=lambda r: -r.g))) for rows in by.values()]
    assert got.ndcg == pytest.approx(sum(a / b if b else 0.0 for a, b in each) / len(each), abs=1e-9)
    assert len(ranked) == 1 + got.evaluations  # what the labels allow, and each trial
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in ranked)
