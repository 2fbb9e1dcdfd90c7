"""Substring search: longest suffixes, fuzzy bags of tokens, scored postings and query relaxation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYNONYM_WEIGHT = 0.95
#: Names of retrieval algorithms, by whether documents need all words; fixed values.
CONJUNCTIVE, DISJUNCTIVE = ("svs", "bwand_and"), ("wand", "bwand_or", "mbwand")


def longest_suffix(text: Column, query: str) -> Column:
    """Length of the longest suffix of the query that the text contains, from the longest down; 0 for none."""
    q, out = query.lower(), F.lit(0)
    low = F.lower(text)
    for k in range(len(q) - 1, -1, -1):
        out = F.when(low.contains(q[k:]), F.lit(len(q) - k)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def suffix_score(texts: list[Column], query: str) -> Column:
    """Over the properties, the sum of matched length by text length."""
    parts = [F.when(F.length(t) > 0, longest_suffix(t, query) / F.length(t)).otherwise(0.0) for t in texts]
    return reduce(lambda a, b: a + b, parts)


def fuzzy_score(text: Column, tokens: dict[str, float], synonyms: dict[str, list[str]] | None = None) -> tuple[Column, Column]:
    """(score, all): the summed weights of tokens that the text contains, and whether it contains all.

    A synonym counts for its token at ``SYNONYM_WEIGHT`` of its weight.
    """
    low, parts, every = F.lower(text), [], F.lit(True)
    for token, weight in tokens.items():
        own = low.contains(token.lower())
        other = reduce(lambda a, b: a | b, [low.contains(s.lower()) for s in (synonyms or {}).get(token, [])], F.lit(False))
        parts.append(F.when(own, F.lit(float(weight))).when(other, F.lit(weight * SYNONYM_WEIGHT)).otherwise(0.0))
        every = every & (own | other)
    return reduce(lambda a, b: a + b, parts, F.lit(0.0)), every


def fuzzy_search(df: DataFrame, text: str, tokens: dict[str, float], threshold: float = 0.0, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows with all tokens, or if there are none, rows whose score is over ``threshold`` of the sum of weights."""
    score, every = fuzzy_score(F.col(text), tokens, synonyms)
    scored = df.withColumn("fuzzy_score", score)
    strict = scored.filter(every)
    return scored.filter(F.col("fuzzy_score") > threshold * sum(tokens.values())) if strict.isEmpty() else strict


def scored_postings(df: DataFrame, key: str, tokens: Column, cap: int = 65535) -> DataFrame:
    """(term, doc, score): a term's occurrences, as a 16-bit score."""
    each = df.select(F.col(key).alias("doc"), F.explode(tokens).alias("term"))
    return each.groupBy("term", "doc").agg(F.least(F.count("*"), F.lit(cap)).alias("score"))


def retrieve(postings: DataFrame, terms: list[str], mode: str = "svs", weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, score): summed scores of documents with all terms (svs, bwand_and) or any (wand, bwand_or, mbwand)."""
    terms = list(dict.fromkeys(terms))
    weight = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, float((weights or {}).get(t, 1.0)))]), F.col("term"))
    got = postings.filter(F.col("term").isin(terms)).groupBy("doc").agg(F.sum(F.col("score") * weight).alias("score"), F.count("*").alias("n"))
    if mode in CONJUNCTIVE:
        got = got.filter(F.col("n") == len(terms))
    elif mode not in DISJUNCTIVE:
        raise ValueError(f"unknown mode {mode}")
    return got.select("doc", "score")


def merge_properties(retrieved: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """(doc, score): the weighted sum of what each property's retrieval (doc, score) gives a document."""
    each = [t.select("doc", (F.col("score") * float(weights.get(p, 1.0))).alias("score")) for p, t in retrieved.items()]
    return reduce(lambda a, b: a.unionByName(b), each).groupBy("doc").agg(F.sum("score").alias("score"))


def relaxations(tokens: list[tuple[str, float]], most: int = 4) -> list[list[str]]:
    """The query and ever shorter ones: of the ``most`` heaviest tokens, the lightest goes first."""
    heavy = sorted(tokens, key=lambda t: -t[1])[:most]
    kept = [[t for t, w in tokens if (t, w) in heavy[:n]] for n in range(len(heavy), 0, -1)]
    return [[t for t, _ in tokens], *[k for k in kept if len(k) < len(tokens)]]


def search_relaxed(search, tokens: list[tuple[str, float]]) -> tuple[list[str], DataFrame]:
    """The first of the relaxations for which ``search(terms)`` has a row, else the last."""
    out = ([], None)
    for terms in relaxations(tokens):
        out = (terms, search(terms))
        if not out[1].isEmpty():
            break
    return out


def abbreviations(query: str, hot: dict[str, float], least: float = 0.0) -> list[str]:
    """Ever shorter prefixes of the words of a query that are hot, longest first."""
    words = [w for w in query.split() if hot.get(w, 0) > least]
    return [" ".join(words[:n]) for n in range(len(words), 0, -1)]
