"""Segments are built by runs of documents: the same tables as by grouping tokens, without moving them."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.analysis import Analyzer
from quillspark.operators import inverted
from quillspark.operators.index import FieldType, IndexSpec, build_index
from quillspark.sources import store
from quillspark.sources.folders import scratch

FIELDS = {"body": FieldType.TEXT, "tag": FieldType.KEYWORD, "kept": FieldType.STORED}
TEXTS = ["The quick Fox, the fox", "", None, "ΑΣ ΣΑΣ ÉCOLE İi straße_x 1٣x ²Ⅷ½", "你好 \U0001f600 \U0001d49c\U00010400 a퟿b", "the a of", "running Runs ran", "x" * 5000, " \n\t"]


def rows_of(df):
    return sorted(map(repr, df.collect()))


def stored(index):
    return [rows_of(x) for x in (index.postings.select("field", "term", "doc_id", "tf", "positions"), index.lengths.select("doc_id", "field", "len"), index.dictionary(), index.field_stats().select("field", "total_len", "doc_count"))]


@pytest.mark.parametrize("analyzer", [Analyzer(), Analyzer(stop=(), stemming=True), Analyzer(custom=lambda c: F.split(c, " "))])
@pytest.mark.parametrize("run", [1, 8 << 20])
def test_the_same_tables_as_by_grouping(spark, monkeypatch, analyzer, run):
    """Rows with null and repeated ids too."""
    monkeypatch.setattr(inverted, "RUN", run)
    ids = [*range(len(TEXTS)), 1, 0, None, None]
    rows = [(i, TEXTS[n % len(TEXTS)], [None, "", "T g", "u"][n % 4], n) for n, i in enumerate(ids)]
    docs, spec = spark.createDataFrame(rows, "doc_id int, body string, tag string, kept int").repartition(3), IndexSpec(FIELDS, analyzer)
    assert stored(store.build_segment(docs, spec, scratch(spark))) == stored(build_index(docs, spec))


def test_fields_with_several_values(spark):
    docs, spec = spark.createDataFrame([(1, ["a fox", None, "fox b"], "t"), (2, None, "")], "doc_id long, body array<string>, tag string"), IndexSpec({"body": FieldType.TEXT, "tag": FieldType.KEYWORD})
    assert stored(store.build_segment(docs, spec, scratch(spark))) == stored(build_index(docs, spec))


def test_tokens_are_not_shuffled(spark, sf):
    """Postings went through two shuffles before, by document and by term."""

    def moved():
        some = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(some.apply(i).totalShuffleWrite() for i in range(some.size()))

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    before = moved()
    index = store.build_segment(docs, IndexSpec({"body": FieldType.TEXT}), scratch(spark))
    assert index.postings.count() > 10_000
    assert moved() - before < docs.agg(F.sum(F.octet_length("body"))).first()[0]
    assert "Exchange" not in inverted.inverted(docs, IndexSpec({"body": FieldType.TEXT}))._jdf.queryExecution().executedPlan().toString()
