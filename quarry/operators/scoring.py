"""Composite scores and reranking of the best hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
RERANK_TOP, PAGE, RELEVANCE_WEIGHT = 4000, 12, 0.01


def weighted_sum(scorers: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, [s * F.lit(float(w)) for s, w in scorers], F.lit(0.0))


def average(scorers: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, scorers) / len(scorers) if scorers else F.lit(0.0)


def pinned(key: Column, ids: list) -> Column:
    """n, n - 1, ... 1 for the listed ids, else 0. The list is a request's, so it is short."""
    if not ids:
        return F.lit(0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, i in enumerate(ids) for x in (i, len(ids) - k)]), key), F.lit(0))


def category(path: Column, labels: list[list[str]], rising: bool = True) -> Column:
    """n..1 (or 1) for the boosted label that is the nearest ancestor of a path, else 0."""
    out = F.lit(0)
    for k, label in sorted(enumerate(labels), key=lambda x: len(x[1])):
        fits = F.slice(path, 1, len(label)) == F.array(*[F.lit(x) for x in label])
        out = F.when(fits, F.lit(len(labels) - k if rising else 1)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def min_max(value: Column, low: float | None, high: float | None) -> Column:
    """(v - min) / (max - min) within 0 and 1; 0 for nulls or an empty span."""
    if low is None or high is None or low == high:
        return F.lit(0.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))), F.lit(0.0))


def exponent(value: Column, low: float, high: float, zoom: float = 1.0) -> Column:
    """(x - 1) / (x + 1) with x = e ** (v / zoom), of a value limited to low..high; 0 for nulls."""
    x = F.exp(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)) / zoom)
    return F.coalesce((x - 1) / (x + 1), F.lit(0.0))


def popularity_table(df: DataFrame, key: str, scorers: list[tuple[Column, float]]) -> DataFrame:
    """(key, popularity): the weighted sum of scorers for each row, to be stored once and joined when ranking."""
    return df.select(key, weighted_sum(scorers).alias("popularity"))


def with_popularity(hits: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``hits`` with ``popularity`` of a stored table; 0 for rows it lacks."""
    return hits.join(table, key, "left").fillna(0.0, ["popularity"])


def random_score(key: Column, seed: int) -> Column:
    """0 to 1, the same for a seed and key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / float(1 << 53)


def normalized(value: Column, mean: float, deviation: float, log_base: float | None = None) -> Column:
    """z-score of the (logarithm of one more than the) value, within -2 and 2, moved up by 2; the mean and deviation are those of what is scored."""
    v = F.log(value + 1) / F.log(F.lit(float(log_base))) if log_base else value
    z = F.lit(0.0) if not deviation else (v - mean) / deviation
    return F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z)) + 2


def exponential(relevance: Column, product: Column, weight: float, scale: float = 1.0) -> Column:
    """A relevance squeezed into 0..1, weighted, plus the product score."""
    return (1 - F.exp(-relevance / scale)) * weight + product


def fuzzy_rank(fuzzy: Column, product: Column, weight: float) -> Column:
    return (fuzzy * weight).cast("int") + product


def similar_products(features: Column, wanted: list, least: float = 0.7) -> Column:
    """Jaccard similarity of feature sets where it is over ``least``, else null."""
    other = F.array(*[F.lit(x) for x in wanted])
    s = F.size(F.array_intersect(features, other)) / F.size(F.array_union(features, other))
    return F.when(s > least, s)


def best_hits(hits: DataFrame, score: str, key: str, top: int = RERANK_TOP) -> DataFrame:
    """The ``top`` hits with their place ``rank`` from 0, by score and, of equals, as they stand by ``key``."""
    few = hits.orderBy(F.desc(score), key).limit(top)
    return few.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(score), key)) - 1)


def diversity_round(group: list[str], merchant: str, rank: str = "rank") -> Column:
    """0, -1, -2, ... for the 1st, 2nd, ... hit of one merchant within a group, so that merchants take turns."""
    return 1 - F.row_number().over(W.partitionBy(*group, merchant).orderBy(rank))


def product_rerank(hits: DataFrame, score: str, category_weight: float, offers: str, merchants: str, merchant_scores: DataFrame | None = None, key: str = "doc_id", top: int = RERANK_TOP, by_page: bool = False, random_seed: int | None = None) -> DataFrame:
    """The best hits in a new order, ``place`` from 1.

    With ``random_seed`` chance takes the place of all that follows the
    category, the same for the same seed.

    Compared in turn, larger first: the whole part of score over category
    weight (by page: of pages of ``PAGE`` hits in it), two offers or more, the
    turn among hits of the same single merchant, the merchant's score, and the
    old place. ``merchants`` is an array; several merchants have turn 0, none
    the last turn. ``merchant_scores`` (merchant, score) is a small table.
    """
    few = best_hits(hits, score, key, top).withColumn("cat", F.floor(F.col(score) / category_weight))
    if by_page:
        few = few.withColumn("cat", -F.floor((F.row_number().over(W.partitionBy("cat").orderBy("rank")) - 1) / PAGE) + F.col("cat") * 1_000_000)
    few = few.withColumn("offer", F.least(F.col(offers), F.lit(2)))
    one = F.when(F.size(merchants) == 1, F.element_at(merchants, 1))
    turn = F.when(one.isNotNull(), diversity_round(["cat"], "_one")).when(F.size(merchants) > 1, 0).otherwise(-top)
    few = few.withColumn("_one", one).withColumn("turn", turn)
    if merchant_scores is not None:
        few = few.join(merchant_scores.select(F.col("merchant").alias("_one"), F.col("score").alias("_m")), "_one", "left")
    else:
        few = few.withColumn("_m", F.lit(0.0))
    then = [F.desc("offer"), F.desc("turn"), F.desc(F.coalesce("_m", F.lit(0.0)))] if random_seed is None else [F.desc(random_score(F.col(key), random_seed))]
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("cat"), *then, "rank")
    return few.withColumn("place", F.row_number().over(order)).drop("_one", "_m")


def merchant_score(hits: DataFrame, path: str, merchant: str, scores: DataFrame) -> DataFrame:
    """``hits`` with ``merchant_score``: of (merchant, category, score) the row of the nearest ancestor of the path, else the general one (null category), else 0."""
    levels = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, 1, n), ">")))
    table = scores.groupBy(F.col("merchant").alias("_m")).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("category", F.lit("")), "score"))).alias("_s"))
    joined = hits.join(table, hits[merchant] == F.col("_m"), "left")
    found = F.filter(F.transform(levels, lambda c: F.element_at(F.col("_s"), F.coalesce(c, F.lit("")))), lambda v: v.isNotNull())
    return joined.withColumn("merchant_score", F.coalesce(F.get(found, F.size(found) - 1), F.lit(0.0))).drop("_m", "_s")


def boost_labels(explicit: list[list[str]], clicked: list[list[str]], known: list[list[str]], limit: int) -> list[list[str]]:
    """The labels to boost: those asked for, then a query's most clicked, then those its source is known for."""
    out = []
    for label in [*explicit, *clicked, *known]:
        if label not in out:
            out.append(label)
    return out[:limit]
