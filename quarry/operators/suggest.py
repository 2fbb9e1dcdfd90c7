"""Query completion and correction from a table of known queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import words


def index_queries(queries: DataFrame, query: str = "query", freq: str = "freq") -> DataFrame:
    """(term, query, freq, n_terms): a row for each distinct word of each query."""
    terms = F.array_distinct(words(F.col(query)))
    return queries.select(F.explode(terms).alias("term"), F.col(query).alias("query"), F.col(freq).alias("freq"), F.size(terms).alias("n_terms"))


def suggest(index: DataFrame, text: list[str], limit: int, categories: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """(query, matched, freq): queries that share most words, then the most frequent; permutations of one query count once.

    With ``categories`` (query, category), three quarters of the list are kept
    for queries of the category, the rest filled up by the others.
    """
    got = index.filter(F.col("term").isin(text)).groupBy("query", "freq").agg(F.count("*").alias("matched"))
    same = F.array_join(F.array_sort(F.split("query", "")), "")
    got = got.groupBy(same.alias("_k")).agg(F.max(F.struct("freq", "matched", "query")).alias("r")).select("r.query", "r.matched", "r.freq")
    order = [F.desc("matched"), F.desc("freq"), F.asc("query")]
    if categories is None:
        return got.orderBy(*order).limit(limit)
    known = got.join(categories.filter(F.col("category") == category).select("query").distinct().withColumn("_own", F.lit(1)), "query", "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    own = known.filter("_own = 1").orderBy(*order).limit(3 * limit // 4)
    rest = known.join(own.select("query"), "query", "left_anti").orderBy(*order).limit(limit)
    return own.unionByName(rest).orderBy(F.desc("_own"), *order).limit(limit).drop("_own")


def complete(queries: DataFrame, prefix: str, limit: int, query: str = "query", freq: str = "freq") -> DataFrame:
    return queries.filter(F.col(query).startswith(prefix)).orderBy(F.desc(freq), query).limit(limit).select(query, freq)


#: How much more likely than the query itself a correction must be; and the weights of its kinds. Fixed values.
ACCEPT, BY_SOUND, BY_NEAR_SOUND, BY_PREFIX = 2.4, 100.0, 50.0, 1.0


def allowed(queries: DataFrame, blocked: DataFrame, query: str = "query") -> DataFrame:
    """Queries that are not in a table of blocked ones."""
    return queries.join(blocked.select(query), query, "left_anti")


def candidates(queries: DataFrame, text: str, sounds: DataFrame | None = None, query: str = "query", freq: str = "freq") -> DataFrame:
    """(correction, score): known queries that ``text`` may stand for, by kind.

    Those that sound the same weigh ``BY_SOUND`` times their frequency, those
    whose sound is one edit away ``BY_NEAR_SOUND`` times, those that ``text``
    begins ``BY_PREFIX`` times. ``sounds`` is (query, sound); how words sound is
    the caller's table, and ``text`` itself is looked up in it.
    """
    out = queries.filter(F.col(query).startswith(text) & (F.col(query) != text)).select(F.col(query).alias("correction"), (F.col(freq) * BY_PREFIX).alias("score"))
    if sounds is not None:
        own = sounds.filter(F.col(query) == text).select(F.col("sound").alias("own"))
        apart = F.levenshtein("sound", "own")
        near = sounds.filter(F.col(query) != text).join(F.broadcast(own), F.abs(F.length("sound") - F.length("own")) <= 1).filter(apart <= 1)
        heard = near.join(queries, query).select(F.col(query).alias("correction"), (F.col(freq) * F.when(apart == 0, BY_SOUND).otherwise(BY_NEAR_SOUND)).alias("score"))
        out = out.unionByName(heard)
    return out.groupBy("correction").agg(F.max("score").alias("score"))


def correct(queries: DataFrame, text: str, by_hand: dict[str, str] | None = None, blocked: tuple[str, ...] = (), edits: int = 2, query: str = "query", freq: str = "freq", sounds: DataFrame | None = None) -> DataFrame:
    """(query, correction, score): at most one row.

    A correction set by hand wins; blocked queries get none. Else known
    queries compete: those of ``candidates``, and those within ``edits`` edits
    by frequency, halved for each edit; the best must be worth more than
    ``ACCEPT`` times the query itself.
    """
    fixed = (by_hand or {}).get(text)
    scored = queries.filter(F.abs(F.length(query) - len(text)) <= edits).select(F.col(query).alias("correction"), F.levenshtein(F.col(query), F.lit(text)).alias("d"), F.col(freq).alias("f")).filter(F.col("d") <= edits)
    scored = scored.withColumn("score", F.col("f") / F.pow(F.lit(2.0), "d"))
    scored = scored.unionByName(candidates(queries, text, sounds, query, freq).select("correction", F.lit(1).alias("d"), F.lit(0).cast("long").alias("f"), "score"))
    own = F.max(F.when(F.col("d") == 0, F.col("f").cast("double")))
    best = scored.agg(F.max(F.when(F.col("d") > 0, F.struct("score", "correction"))).alias("b"), own.alias("own"))
    out = best.select(F.lit(text).alias("query"), F.col("b.correction").alias("correction"), F.col("b.score").alias("score"), "own")
    if text in blocked:
        return out.filter("false").drop("own")
    if fixed:
        return out.select("query", F.lit(fixed).alias("correction"), F.lit(float("inf")).alias("score"))
    return out.filter((F.col("score") > ACCEPT * F.coalesce("own", F.lit(0.0)))).drop("own")


def same_category(left: Column, right: Column) -> Column:
    """Whether two queries may be of one category: nothing is known of the left, or they share one."""
    return left.isNull() | (F.size(left) == 0) | F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def evaluate(results: DataFrame, got: str = "correction", wanted: str = "wanted") -> DataFrame:
    """(precision, recall) of corrections; null is no correction."""
    hit = F.count(F.when(F.col(got) == F.col(wanted), 1))
    return results.agg(F.try_divide(hit, F.count(got)).alias("precision"), F.try_divide(hit, F.count(wanted)).alias("recall"))
