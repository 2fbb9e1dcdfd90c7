"""Analyzers and text for display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.bind import once

MARKS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), MARKS), lambda w: w != "")


def unigrams(text: Column) -> Column:
    """Single characters, without blanks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: F.trim(c) != "")


def bigrams(text: Column) -> Column:
    """Words of one kind (Han characters, or letters and digits); Han runs as overlapping pairs."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2,}$"), pairs(r)).otherwise(F.array(r))))


def segment(text: Column, dictionary: list[str]) -> Column:
    """Forward maximum matching: at each place the longest word of the dictionary, else a run of Latin letters or digits, else one sign.

    The dictionary is a request's or a small lexicon; it becomes one pattern.
    """
    known = "|".join(re.escape(w.lower()) for w in sorted(set(dictionary), key=lambda w: (-len(w), w)))
    pattern = "(" + (known + "|" if known else "") + r"[a-z0-9]+|[\p{L}\p{N}])"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))


def virtual(properties: list[str]) -> Column:
    """Several properties searched as one text."""
    return F.concat_ws(" ", *properties)


def ngrams(text: Column, least: int = 2, most: int = 3) -> Column:
    """All runs of ``least`` to ``most`` signs of each word; shorter words as they are."""

    def of_length(w: Column, n: int) -> Column:
        starts = F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(w, i, F.lit(n)))

    def of(w: Column) -> Column:
        return F.when(F.length(w) < least, F.array(w)).otherwise(F.concat(*[of_length(w, n) for n in range(least, most + 1)]))

    return F.flatten(F.transform(words(text), of))


def matrix(text: Column, most: int = 8) -> Column:
    """All runs of up to ``most`` signs of each word."""
    return ngrams(text, 1, most)


def without(tokens: Column, stop_words: list[str]) -> Column:
    """Words that aren't stop words, in order."""
    return F.filter(tokens, lambda w: ~w.isin([s.lower() for s in stop_words])) if stop_words else tokens


def md5_id(text: Column) -> Column:
    """A document's id from its own name: 32 hexadecimal digits."""
    return F.md5(F.encode(text, "UTF-8"))


#: Analyzers by the kind of text they are for.
ANALYZERS = {"words": words, "unigrams": unigrams, "bigrams": bigrams, "token": words, "char": unigrams, "ngram": ngrams, "matrix": matrix, "english": words, "chinese": bigrams, "japanese": bigrams, "multilang": bigrams}


def attribute_tokens(text: Column, dictionary: dict[str, int]) -> Column:
    """array<struct<token, score>>: words of a small dictionary that a text has, longest first at each place, with their scores."""
    found = segment(text, list(dictionary))
    scores = F.create_map(*[F.lit(x) for k, v in dictionary.items() for x in (k.lower(), v)]) if dictionary else F.create_map().cast("map<string,int>")
    return F.filter(F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("token"), F.element_at(scores, t).alias("score"))), lambda s: s["score"].isNotNull())


def query_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def normalized_query(text: str) -> str:
    """Lower-cased words in order of their characters, so that equal bags of words are equal text."""
    return " ".join(sorted(text.lower().split()))


def normalized(text: Column) -> Column:
    """``normalized_query`` of a column; null for null."""
    words = F.filter(F.split(F.lower(text), r"[\p{Z}\x09-\x0D\x1C-\x1F\x85]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """``text`` with each whole-word occurrence of a term between tags, whatever its case."""
    if not terms:
        return text
    either = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")


def sentences(text: Column) -> Column:
    """Sentences with their closing marks, trimmed, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^.!?。！？\n]+[.!?。！？]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda v: F.trim(v)), lambda s: s != "")


def _tf(tokens: Column, terms: list[str]) -> Column:
    wanted = F.array(*[F.lit(t) for t in terms])
    return F.size(F.filter(tokens, lambda w: F.array_contains(wanted, w)))


def snippet(text: Column, terms: list[str], most: int = 2, mark: str = "...") -> Column:
    """The ``most`` sentences densest in terms, in their order, joined by an ellipsis; the first sentence if none has any.

    A sentence's density is its number of terms over its words plus one.
    """
    if not terms:
        return F.element_at(F.concat(sentences(text), F.array(F.lit(""))), 1)
    rated = F.transform(sentences(text), lambda s, i: F.struct(once(words(s), lambda w: -_tf(w, terms).cast("double") / (F.size(w) + 1)).alias("d"), i.alias("i"), s.alias("s")))
    return once(F.slice(F.array_sort(F.filter(rated, lambda r: r["d"] < 0)), 1, most), lambda best: _joined(best, text, mark))


def _joined(best: Column, text: Column, mark: str) -> Column:
    chosen = F.transform(F.array_sort(F.transform(best, lambda r: F.struct(r["i"], r["s"]))), lambda r: r["s"])
    first = F.element_at(F.concat(sentences(text), F.array(F.lit(""))), 1)
    return F.when(F.size(best) > 0, F.array_join(chosen, f" {mark} ")).otherwise(first)


def summary(text: Column, most: int = 3) -> Column:
    """Sentences picked greedily by the summed counts of their words in the whole text, words already covered counting nothing.

    Ties go to the earlier sentence; the picked ones come in their order.
    """
    rows = F.transform(sentences(text), lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.array_distinct(words(s)).alias("w")))
    return once(F.struct(words(text).alias("every"), rows.alias("tables")), lambda v: _summary(v["every"], v["tables"], most))


def _summary(every: Column, tables: Column, most: int) -> Column:
    count = lambda w: F.size(F.filter(every, lambda x: x == w))

    def step(acc, _):
        worth = lambda t: F.aggregate(F.array_except(t["w"], acc["seen"]), F.lit(0), lambda a, w: a + count(w))
        left = F.filter(tables, lambda t: ~F.array_contains(acc["took"], t["i"]))
        best = F.array_max(F.transform(left, lambda t: F.struct(worth(t).alias("v"), (-t["i"]).alias("n"), t["w"].alias("w"))))
        none = F.array().cast("array<string>")
        return F.struct(F.when(best.isNull(), acc["took"]).otherwise(F.array_append(acc["took"], -best["n"])).alias("took"), F.array_union(acc["seen"], F.coalesce(best["w"], none)).alias("seen"))

    start = F.struct(F.array().cast("array<int>").alias("took"), F.array().cast("array<string>").alias("seen"))
    took = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["took"]
    return F.array_join(F.transform(F.filter(tables, lambda t: F.array_contains(took, t["i"])), lambda t: t["s"]), " ")
