"""The query algebra: immutable nodes with their canonical text."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Occur(Enum):
    MUST = "+"
    SHOULD = ""
    MUST_NOT = "-"


class Query:
    """Base of all nodes."""


@dataclass(frozen=True)
class TermQuery(Query):
    field: str
    term: str

    def __str__(self) -> str:
        return f"{self.field}:{self.term}"


@dataclass(frozen=True)
class PhraseQuery(Query):
    field: str
    terms: tuple[str, ...]

    def __init__(self, field: str, terms: list[str] | tuple[str, ...]) -> None:
        if not terms:
            raise ValueError("a phrase needs a term")
        object.__setattr__(self, "field", field)
        object.__setattr__(self, "terms", tuple(terms))

    def __str__(self) -> str:
        return f'{self.field}:"{" ".join(self.terms)}"'


@dataclass(frozen=True)
class PrefixQuery(Query):
    field: str
    prefix: str

    def __str__(self) -> str:
        return f"{self.field}:{self.prefix}*"


@dataclass(frozen=True)
class MatchAllQuery(Query):
    boost: float = 1.0

    def __str__(self) -> str:
        return "*:*"


@dataclass(frozen=True)
class Clause:
    query: Query
    occur: Occur

    def __str__(self) -> str:
        return f"{self.occur.value}({self.query})"


@dataclass(frozen=True)
class BooleanQuery(Query):
    clauses: tuple[Clause, ...] = ()
    min_should: int = 0

    def __str__(self) -> str:
        return f"({' '.join(map(str, self.clauses))})"

    def of(self, occur: Occur) -> list[Query]:
        return [c.query for c in self.clauses if c.occur is occur]

    @staticmethod
    def builder() -> Builder:
        return Builder()


@dataclass
class Builder:
    clauses: list[Clause] = field(default_factory=list)
    min_should: int = 0

    def add(self, query: Query, occur: Occur) -> Builder:
        self.clauses.append(Clause(query, occur))
        return self

    def must(self, query: Query) -> Builder:
        return self.add(query, Occur.MUST)

    def should(self, query: Query) -> Builder:
        return self.add(query, Occur.SHOULD)

    def must_not(self, query: Query) -> Builder:
        return self.add(query, Occur.MUST_NOT)

    def minimum_should_match(self, n: int) -> Builder:
        self.min_should = n
        return self

    def build(self) -> BooleanQuery:
        return BooleanQuery(tuple(self.clauses), self.min_should)
