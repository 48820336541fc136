"""Similarities as column expressions: pluggable pairs of idf and score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Similarity:
    def idf(self, df: Column, n: Column) -> Column:
        raise NotImplementedError

    def score(self, tf: Column, idf: Column, length: Column, average: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class BM25(Similarity):
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be at least 0, b in [0, 1]")

    def idf(self, df: Column, n: Column) -> Column:
        return F.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(self, tf: Column, idf: Column, length: Column, average: Column) -> Column:
        norm = F.when(average > 0, 1 - self.b + self.b * length / average).otherwise(1.0)
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * norm)


@dataclass(frozen=True)
class TfIdf(Similarity):
    def idf(self, df: Column, n: Column) -> Column:
        return 1 + F.log(n / (df + 1))

    def score(self, tf: Column, idf: Column, length: Column, average: Column) -> Column:
        return F.sqrt(tf.cast("double")) * idf * idf / F.when(length > 0, F.sqrt(length.cast("double"))).otherwise(1.0)
