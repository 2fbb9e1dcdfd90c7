"""Query-log and click analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_keywords(log: DataFrame, limit: int, query: str = "query", hits: str = "hit_docs_num", when: str = "ts") -> DataFrame:
    """Distinct queries with hits, the latest first."""
    return log.filter(F.col(hits) > 0).groupBy(query).agg(F.max(when).alias("latest")).orderBy(F.desc("latest"), query).limit(limit)


def keyword_frequency(log: DataFrame, since, query: str = "query", hits: str = "hit_docs_num", when: str = "ts") -> DataFrame:
    return log.filter(F.col(when) >= since).groupBy(query).agg(F.max(hits).alias("max_hits"), F.count("*").alias("count"))


def latest_per_key(log: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """Each key's latest row and its number of rows, in one aggregation."""
    fields = F.struct(*[F.col(c) for c in [when, tie, *[c for c in log.columns if c not in (key, when, tie)]]])
    last = log.groupBy(key).agg(F.max(F.struct(F.col(when), F.col(tie))).alias("_m"), F.max_by(fields, F.struct(F.col(when), F.col(tie))).alias("_r"), F.count("*").alias("count"))
    return last.select(key, "_r.*", "count")


def label_totals(labels: DataFrame, label: str = "label_name", hits: str = "hit_docs_num") -> DataFrame:
    return labels.groupBy(label).agg(F.sum(hits).alias("total"))


def top_values(df: DataFrame, by: list[str], value: str, limit: int) -> DataFrame:
    """(by, value, count): each group's most frequent values; ties by value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("count"))
    if not by:
        return counts.orderBy(F.desc("count"), value).limit(limit)
    w = W.partitionBy(*by).orderBy(F.desc("count"), value)
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def distinct_count(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count_distinct(value).alias("distinct_count"))


def click_labels(clicks: DataFrame, limit: int, pinned: DataFrame | None = None, query: str = "query", label: str = "label") -> DataFrame:
    """(query, label, count): the most clicked labels of each query; labels pinned by hand come first."""
    counts = clicks.groupBy(query, label).agg(F.count("*").alias("count")).withColumn("_first", F.lit(0))
    if pinned is not None:
        counts = counts.join(pinned.select(query, label, F.lit(1).alias("_pin")).distinct(), [query, label], "full").select(query, label, F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("_pin", F.lit(0)).alias("_first"))
    w = W.partitionBy(query).orderBy(F.desc("_first"), F.desc("count"), label)
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r", "_first")


def auto_labels(clicks: DataFrame, query: str, count: int) -> list[str]:
    """A query's most clicked labels, to be used as filters."""
    return [r["label"] for r in click_labels(clicks.filter(F.col("query") == query), count).collect()]


def near_label(a: Column, b: Column) -> Column:
    """Whether two labels are spellings of one: equal length and first sign, fewer than 4 edits."""
    return (F.length(a) == F.length(b)) & (F.substr(a, F.lit(1), F.lit(1)) == F.substr(b, F.lit(1), F.lit(1))) & (F.levenshtein(a, b) < 4)
