"""The benchmark corpus: uniform words over a generated vocabulary, a function of the seed and the row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of the harness by default.
DOCUMENTS = 50_000


def _base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def _phrase(salt: int, least: int, spread: int, vocabulary: int, seed: int) -> Column:
    draw = lambda *x: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("doc_id"), *x), F.lit(2**62))
    count = (draw(F.lit(-1)) % spread + least).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("term"), _base36(draw(i) % vocabulary))), " ")


def corpus(spark: SparkSession, n: int, vocabulary: int = 2000, seed: int = 42) -> DataFrame:
    """(doc_id, id, title, body): titles of 4 to 9 words, bodies of 30 to 89."""
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"), _phrase(1, 4, 6, vocabulary, seed).alias("title"), _phrase(2, 30, 60, vocabulary, seed).alias("body"))


def queries(spark: SparkSession, n: int = 200, vocabulary: int = 2000, seed: int = 42) -> DataFrame:
    """(query_id, kind, a, b): a third each of terms, conjunctions and phrases."""
    word = lambda salt: F.concat(F.lit("term"), _base36(F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("query_id")), F.lit(vocabulary))))
    kind = F.element_at(F.array(F.lit("term"), F.lit("and"), F.lit("phrase")), (F.col("query_id") % 3 + 1).cast("int"))
    return spark.range(n).withColumnRenamed("id", "query_id").select("query_id", kind.alias("kind"), word(11).alias("a"), word(12).alias("b"))
