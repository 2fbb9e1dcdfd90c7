"""Facets over a stream of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths


def totals(hits: DataFrame, ranges: list[str] = (), sums: list[str] = ()) -> DataFrame:
    """total_count, min_ and max_ of some columns and sum_ of others, in one pass."""
    aggs = [F.count("*").alias("total_count")]
    for c in ranges:
        aggs += [F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}")]
    return hits.agg(*aggs, *[F.sum(c).alias(f"sum_{c}") for c in sums])


def values(hits: DataFrame, column: str) -> DataFrame:
    """(value, count) of a string or number."""
    return hits.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def dates(hits: DataFrame, column: str, unit: str) -> DataFrame:
    """(value, count) by year, month or day; of several dates in a document each distinct unit counts once."""
    if dict(hits.dtypes)[column].startswith("array"):
        each = F.explode(F.array_distinct(F.transform(F.col(column), lambda d: paths.date_label(d, unit))))
    else:
        each = paths.date_label(F.col(column), unit)
    return hits.filter(F.col(column).isNotNull()).select(each.alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def sub_facet(hits: DataFrame, column: str, below: str) -> DataFrame:
    """(value, sub_value, count): totals of each value have a null sub_value. One aggregation for both levels."""
    some = hits.filter(F.col(column).isNotNull())
    sets = some.groupingSets([[F.col(column)], [F.col(column), F.col(below)]], F.col(column), F.col(below))
    out = sets.agg(F.count("*").alias("count"), F.grouping(below).alias("g"))
    return out.filter(F.col(below).isNotNull() | (F.col("g") == 1)).select(F.col(column).alias("value"), F.col(below).alias("sub_value"), "count")


def hierarchy(hits: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """(path, level, count) for array<array<string>> of paths; level 0 counts documents with any path.

    A node's count is that of its own documents plus those of the nodes below
    it: a document with two paths under a node counts twice there.
    """
    some = hits.filter(F.size(column) > 0)
    own = some.select(F.explode(F.array_distinct(F.col(column))).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    nodes = own.select(F.explode(paths.prefixes(F.col("leaf"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("count"))
    total = some.agg(F.count("*").alias("count")).select(F.array().cast("array<string>").alias("path"), "count")
    return nodes.unionByName(total).select(F.array_join("path", ">").alias("path"), F.size("path").alias("level"), F.col("count").cast("long").alias("count"))


def attributes(hits: DataFrame, column: str, exclude: list[str] = (), least: int = 1, top_names: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, count) by documents and (name, value, count) by occurrences of array<struct<name, values>>."""
    named = hits.select(F.explode(column).alias("a")).select("a.name", "a.values").filter(~F.col("name").isin(list(exclude))) if exclude else hits.select(F.explode(column).alias("a")).select("a.name", "a.values")
    per_doc = hits.select(F.explode(F.array_distinct(F.transform(column, lambda a: a["name"]))).alias("name"))
    if exclude:
        per_doc = per_doc.filter(~F.col("name").isin(list(exclude)))
    names = per_doc.groupBy("name").agg(F.count("*").alias("count"))
    if top_names:
        names = names.orderBy(F.desc("count"), "name").limit(top_names)
    each = named.select("name", F.explode("values").alias("value")).groupBy("name", "value").agg(F.count("*").alias("count")).filter(F.col("count") >= least)
    return names, each.join(names.select("name"), "name", "left_semi") if top_names else each


def attribute_scores(hits: DataFrame, column: str, weights: DataFrame, least: float = 0.0) -> DataFrame:
    """(name, value, score): occurrences times the weight of (name, value) in a category's dictionary; unknown pairs weigh nothing."""
    _, each = attributes(hits, column)
    scored = each.join(weights, ["name", "value"]).select("name", "value", (F.col("count") * F.col("weight")).alias("score"))
    return scored.filter(F.col("score") > least)


def group_top(facet: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """Labels whose count is at least the k-th largest; ties stay. Without ``by`` a bounded top k finds that count."""
    if by:
        w = W.partitionBy(*by).orderBy(F.desc("count"))
        return facet.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k).drop("_r")
    kth = facet.orderBy(F.desc("count")).limit(k).agg(F.min("count").alias("kth")).scalar()
    return facet.filter(F.col("count") >= kth)


def drill_sideways(hits: DataFrame, labels: dict[str, Column]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Hits that pass all labels, and for each label's own facet also those that fail no other.

    One pass marks each hit with what it fails; the facet of a label counts
    hits that fail nothing or only that label.
    """
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in labels.items()]), lambda x: x.isNotNull())
    marked = hits.withColumn("_failed", failed)
    none = marked.filter(F.size("_failed") == 0).drop("_failed")
    sideways = {n: marked.filter((F.size("_failed") == 0) | (F.col("_failed") == F.array(F.lit(n)))).drop("_failed") for n in labels}
    return none, sideways


SEGMENTS, CELLS, RANGES = 7, 100, 7


def number_cells(hits: DataFrame, column: str) -> DataFrame:
    """(segment, cell, count) of positive whole numbers.

    Segments end at 1000, 10000, ... 1e9 and have 100 cells each; larger
    numbers fall into the last. The histogram has 700 rows at most.
    """
    v = F.least(F.col(column).cast("long"), F.lit(10**9 - 1))
    segment = reduce(lambda a, k: F.when(v < 10 ** (k + 3), F.lit(k)).otherwise(a), range(SEGMENTS - 1, -1, -1), F.lit(SEGMENTS - 1))
    width = F.pow(F.lit(10.0), segment + 1).cast("long")
    return hits.filter(F.col(column) > 0).select(segment.alias("segment"), F.floor(v / width).cast("int").alias("cell")).groupBy("segment", "cell").agg(F.count("*").alias("count"))


def number_ranges(cells: list[tuple[int, int, int]], most: int = RANGES) -> list[tuple[int, int, int]]:
    """At most ``most`` ranges (low, high, count) from a histogram, about equal counts in each.

    Every segment with numbers gets one range; each further one goes to the
    segment where it lowers the variance of counts most, n * n / (k * (k + 1))
    for n numbers in k ranges. A range takes cells as long as that brings the
    count so far nearer to its share. Ranges start and end at cells in use.
    """
    used: dict[int, list[tuple[int, int]]] = {}
    for segment, cell, count in sorted(cells):
        if count:
            used.setdefault(segment, []).append((cell, count))
    total = {s: sum(n for _, n in c) for s, c in used.items()}
    share = dict.fromkeys(used, 1)
    for _ in range(most - len(used)):
        open_ = [s for s in used if total[s] > share[s]]
        if not open_:
            break
        share[max(open_, key=lambda s: (total[s] ** 2 / share[s] / (share[s] + 1), -s))] += 1
    out = []
    for s, own in used.items():
        width, at, done = 10 ** (s + 1), 0, 0
        for k in range(1, share[s] + 1):
            goal, start, before = -(-k * total[s] // share[s]), at, done
            while at < len(own) and (k == share[s] or 2 * (done - goal) + own[at][1] < 0):
                done += own[at][1]
                at += 1
            if at > start:
                out.append((own[start][0] * width, (own[at - 1][0] + 1) * width - 1, done - before))
    return out


def ranges(hits: DataFrame, column: str, most: int = RANGES) -> DataFrame:
    """(value, low, high, count) of ``number_ranges``; its histogram, 700 rows at most, comes to the driver."""
    found = [tuple(r) for r in number_cells(hits, column).collect()]
    rows = [(f"{low}-{high}", low, high, n) for low, high, n in number_ranges(found, most)]
    return hits.sparkSession.createDataFrame(rows, "value string, low long, high long, count long")


def tree(hits: DataFrame, column: str) -> DataFrame:
    """(value, level, count) of the nodes of a string's category paths (``A>B,C``); a plain string is a path of one node."""
    nodes = hierarchy(hits.select(paths.group_paths(F.col(column)).alias("p")), "p")
    return nodes.filter("level > 0").select(F.col("path").alias("value"), "level", "count")


def key_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("key_count"))
