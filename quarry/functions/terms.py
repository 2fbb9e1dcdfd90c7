"""What matching and ranking ask of a document's words, however these are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.bind import once


class Words:
    """Words as an array column in order."""

    def __init__(self, tokens: Column):
        self.tokens = tokens

    def places(self, word: str) -> Column:
        return F.filter(F.transform(self.tokens, lambda t, i: F.when(t == word, i)), lambda i: i.isNotNull())

    def count(self, word: str) -> Column:
        return F.size(F.filter(self.tokens, lambda t: t == word))

    def has(self, word: str) -> Column:
        return F.array_contains(self.tokens, word)

    def like(self, pattern: str) -> Column:
        return F.exists(self.tokens, lambda t: t.rlike(pattern))

    @property
    def length(self) -> Column:
        return F.size(self.tokens)

    def bound(self, use: Callable[[Words], Column]) -> Column:
        """``use(words)``, with the array computed once a row."""
        return once(self.tokens, lambda t: use(Words(t)))


class Posted:
    """Words as columns read from postings: the places of each word asked for, and whether a pattern fits one."""

    def __init__(self, length: Column, places: dict[str, Column], patterns: dict[str, Column]):
        self.length, self._places, self._patterns = length, places, patterns

    def places(self, word: str) -> Column:
        return F.coalesce(self._places[word], F.array().cast("array<int>"))

    def count(self, word: str) -> Column:
        return F.coalesce(F.size(self._places[word]), F.lit(0))

    def has(self, word: str) -> Column:
        return self._places[word].isNotNull()

    def like(self, pattern: str) -> Column:
        return F.coalesce(self._patterns[pattern], F.lit(False))

    def bound(self, use: Callable[[Posted], Column]) -> Column:
        return use(self)


def as_words(tokens: Column | Words | Posted) -> Words | Posted:
    return Words(tokens) if isinstance(tokens, Column) else tokens
