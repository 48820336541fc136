"""From raw documents to token ids: language, near copies, personal data, source mix, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, langid, mixing, pii, simhash
from quillspark.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", langid.stage),
    ("near_duplicates", simhash.stage),
    ("personal_data", pii.stage),
    ("mixing", mixing.stage),
    ("tokens", bpe.stage),
]
#: Trained models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written as Parquet and read again.

    A row for each document that is left, and one more for each epoch in which the mix repeats it: (doc_id, ids, n_tokens,
    exact, place); sorted by ``place`` they are in the order of the mix.

    Cases: documents with a null or empty text, or without a letter, are rejected by the first stage wherever a language is
    known; in a table without any label they pass it, have no copies and no personal data, count as no characters of the
    mix, and get null or empty ids.  Of repeated rows and copies the smallest ``doc_id`` stays; all rows of that id stay.
    Rows with a null ``doc_id`` are in no group of copies.  Nulls in other columns: a null source is the source ''.  Ties
    are settled as each stage says.  An empty table gives an empty one.  Extra columns go along to the mix, whatever their
    names.  Texts of any length are handled whole.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
