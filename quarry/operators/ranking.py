"""Relevance: collection statistics and BM25, language-model and proximity scores.

Scores ask for a document's words through ``functions.terms``: from an array of
the text's words in a scan, or from stored postings (``sources.postings``),
which also keep the collection statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.bind import once
from quarry.functions.terms import Posted, Words, as_words

#: Fixed values.
K1, B, K3, LEAST_IDF = 1.2, 0.75, 1000.0, 0.1
MU, LAMBDA, PROXIMITY_BASE = 2000.0, 1000.0, 3.0


@dataclass
class Stats:
    """Of one property: documents, words in all, and per query word df, ctf and the largest tf."""

    n: int
    total: int
    df: dict[str, int] = field(default_factory=dict)
    ctf: dict[str, int] = field(default_factory=dict)
    maxtf: dict[str, int] = field(default_factory=dict)

    @property
    def average(self) -> float:
        return self.total / self.n if self.n else 0.0


def collect_stats(df: DataFrame, tokens: Column, words: list[str]) -> Stats:
    """One aggregation over all rows; a single row reaches the driver."""
    words = list(dict.fromkeys(words))
    counted = df.select(tokens.alias("_t")).select(F.size("_t").alias("len"), *[Words(F.col("_t")).count(w).alias(f"t{k}") for k, w in enumerate(words)])
    aggs = [F.count("*").alias("n"), F.sum("len").alias("total")]
    for k in range(len(words)):
        aggs += [F.count(F.when(F.col(f"t{k}") > 0, 1)).alias(f"df{k}"), F.sum(f"t{k}").alias(f"ctf{k}"), F.max(f"t{k}").alias(f"max{k}")]
    r = counted.agg(*aggs).first()
    pick = lambda p: {w: r[f"{p}{k}"] or 0 for k, w in enumerate(words)}
    return Stats(r["n"], r["total"] or 0, pick("df"), pick("ctf"), pick("max"))


def idf(stats: Stats, word: str) -> float:
    df = min(stats.df.get(word, 0), stats.n)
    return max(math.log((stats.n - df + 0.5) / (df + 0.5)), LEAST_IDF)


def bm25(tokens: Words | Posted, words: list[str], stats: Stats, k1: float = K1, b: float = B, k3: float = K3) -> Column:
    """0 where the collection has no words at all."""
    if not stats.total or not words:
        return F.lit(0.0)
    length = k1 * (b * tokens.length / stats.average + (1 - b))
    parts = []
    for w, qtf in Counter(words).items():
        t = tokens.count(w)
        parts.append(F.lit(idf(stats, w) * (k3 + 1) * qtf / (k3 + qtf)) * (F.lit(k1 + 1) * t) / (length + t))
    return reduce(lambda x, y: x + y, parts)


def bm25_bound(stats: Stats, word: str, k1: float = K1, b: float = B) -> float:
    """The most that a word can add: its largest frequency in a document of just that length."""
    if not stats.total:
        return 0.0
    t = stats.maxtf.get(word, 0)
    return idf(stats, word) * (k1 + 1) * t / (k1 * (b * t / stats.average + 1 - b) + t) if t else 0.0


def kl(tokens: Words | Posted, words: list[str], stats: Stats, mu: float = MU) -> Column:
    """Query likelihood with Dirichlet smoothing, relative to a document without the words."""
    if not stats.total or not words:
        return F.lit(0.0)
    parts = []
    for w, qtf in Counter(words).items():
        p = stats.ctf.get(w, 0) / stats.total
        if p > 0:
            t = tokens.count(w)
            parts.append(F.when(t > 0, F.lit(qtf / len(words)) * F.log((t + mu * p) / (mu * p))).otherwise(0.0))
    if not parts:
        return F.lit(0.0)
    score = reduce(lambda x, y: x + y, parts)
    return F.when(score > 0, score + F.log(F.lit(mu) / (mu + tokens.length))).otherwise(score)


def closeness(a: Column, b: Column, base: float = PROXIMITY_BASE) -> Column:
    """base ** -d for the closest places of two words, twice that where they touch; 0 if either is missing."""
    d = F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(x - y)))))
    return F.when(d.isNull(), 0.0).when(d == 1, F.lit(2.0 / base)).otherwise(F.pow(F.lit(base), -d.cast("double")))


def plm(tokens: Words | Posted, words: list[str], stats: Stats, mu: float = MU, lam: float = LAMBDA) -> Column:
    """The language model with each word's frequency raised by its mean closeness to the others."""
    unique = list(Counter(words))
    if not stats.total or not unique:
        return F.lit(0.0)
    return once(F.array(*[tokens.places(w) for w in unique]), lambda found: _plm(found, tokens.length, words, unique, stats, mu, lam))


def _plm(found: Column, length: Column, words: list[str], unique: list[str], stats: Stats, mu: float, lam: float) -> Column:
    place = {w: F.element_at(found, k + 1) for k, w in enumerate(unique)}
    near = {w: F.lit(0.0) if len(unique) == 1 else reduce(lambda x, y: x + y, [closeness(place[w], place[v]) for v in unique if v != w]) / (len(unique) - 1) for w in unique}
    parts = []
    for w, qtf in Counter(words).items():
        p = stats.ctf.get(w, 0) / stats.total
        if p > 0:
            t = F.size(place[w])
            parts.append(F.when(t > 0, F.lit(qtf / len(words)) * F.log((t + lam * near[w] + mu * p) / (mu * p))).otherwise(0.0))
    if not parts:
        return F.lit(0.0)
    score, close = reduce(lambda x, y: x + y, parts), reduce(lambda x, y: x + y, near.values())
    return F.when(score > 0, score + F.log(F.lit(mu) / (mu + length + lam * close))).otherwise(score)


def _once(score):
    return lambda tokens, words, stats: as_words(tokens).bound(lambda t: score(t, words, stats))


MODELS = {"bm25": _once(bm25), "kl": _once(kl), "plm": _once(plm), "none": lambda tokens, words, stats: F.lit(0.0)}


def model(name: str | None, default: str = "bm25"):
    return MODELS.get((name or default).lower(), MODELS[default])


def multi_property(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    return reduce(lambda x, y: x + y, [F.lit(float(weights.get(p, 1.0))) * s for p, s in scores.items()])


def personal_boost(tokens, profile: dict[str, float], share: float = 0.1) -> Column:
    """What a user's terms add to a score, matching or not: frequency times weight times ``share``."""
    if not profile:
        return F.lit(0.0)
    return as_words(tokens).bound(lambda t: reduce(lambda x, y: x + y, [t.count(w) * F.lit(v * share) for w, v in profile.items()]))
