"""Text analysis as column expressions: everything but stemming and offsets stays in the JVM.

``tokens`` gives terms with character offsets and positions, ``analyzed`` what an index needs: the terms that
survive, with their positions across the values of a field.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.stemmer import stem, stemmed

#: Letters and decimal digits; anything else, the underscore included, separates.
TOKEN = r"([\p{L}\p{Nd}]+)"
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Positions between the values of a field.
GAP = 100


def words(text: Column) -> Column:
    """Tokens as written; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))


def tokens(text: Column) -> Column:
    """array<struct<term, start, end, pos_inc>>: lower-case tokens with character offsets, nothing removed.

    Offsets come from one walk over the text, in Arrow batches: a running sum over tokens would be quadratic in SQL.
    """

    @F.pandas_udf("array<struct<term:string,start:int,end:int,pos_inc:int>>")
    def run(texts: pd.Series) -> pd.Series:
        import regex

        token = regex.compile(TOKEN)
        return texts.map(lambda t: [{"term": m[0].lower(), "start": m.start(), "end": m.end(), "pos_inc": 1} for m in token.finditer(t or "")])

    return run(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Analyzer:
    """Tokens, lower case, stop words, and stems if asked for.

    ``custom``, text -> array<string>, takes the place of all four: its terms stand as they come.
    """

    stop: Collection[str] = STOP_WORDS
    stemming: bool = False
    custom: Callable[[Column], Column] | None = field(default=None, compare=False)

    def kept(self, text: Column) -> Column:
        """array<struct<term, r>> of the surviving terms; r is the token's place before removal."""
        all_terms = self.custom(text) if self.custom else F.transform(words(text), F.lower)
        both = F.transform(all_terms, lambda t, i: F.struct(t.alias("term"), i.alias("r")))
        if self.custom:
            return both
        if self.stop:
            both = F.filter(both, lambda x: ~x["term"].isin(list(self.stop)))
        if self.stemming:
            both = F.arrays_zip(stemmed(F.transform(both, lambda x: x["term"])).alias("term"), F.transform(both, lambda x: x["r"]).alias("r"))
        return both

    def terms(self, text: Column) -> Column:
        return F.transform(self.kept(text), lambda x: x["term"])

    def query_terms(self, text: str) -> list[str]:
        """The same on the driver, for query texts."""
        import regex

        found = [t.lower() for t in regex.findall(TOKEN, text)]
        return [stem(t) if self.stemming else t for t in found if t not in self.stop]


@dataclass(frozen=True)
class KeywordAnalyzer:
    """A whole value is one term; an empty one has none."""

    lowercase: bool = False

    def kept(self, text: Column) -> Column:
        term = F.lower(text) if self.lowercase else text
        none = F.array().cast("array<struct<term:string,r:int>>")
        return F.when(text.isNull() | (text == ""), none).otherwise(F.array(F.struct(term.alias("term"), F.lit(0).alias("r"))))

    def terms(self, text: Column) -> Column:
        return F.transform(self.kept(text), lambda x: x["term"])


def field_terms(values: Column, analyzer: Analyzer | KeywordAnalyzer, gap: int = GAP) -> Column:
    """array<struct<term, pos>> of a field with the values of an array, in order.

    The first value starts at 0.  The next one starts ``gap`` behind the last surviving token of those before; a
    value without such a token still adds the gap.
    """
    each = F.transform(F.coalesce(values, F.array().cast("array<string>")), analyzer.kept)
    reach = F.transform(each, lambda v: F.coalesce(F.try_element_at(v, F.lit(-1))["r"] + 1, F.lit(0)) + gap)
    base = F.transform(each, lambda v, i: F.aggregate(F.slice(reach, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    return F.flatten(F.transform(F.arrays_zip(each.alias("v"), base.alias("b")), lambda z: F.transform(z["v"], lambda x: F.struct(x["term"].alias("term"), (x["r"] + z["b"]).cast("int").alias("pos")))))


def single_terms(text: Column, analyzer: Analyzer | KeywordAnalyzer) -> Column:
    """The same for a field with one value."""
    return F.transform(analyzer.kept(text), lambda x: F.struct(x["term"].alias("term"), x["r"].cast("int").alias("pos")))
