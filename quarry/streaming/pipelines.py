"""Structured Streaming: incremental upserts, click counters, event-time windows and click models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.collections import Collections
from quarry.sources.store import latest, upsert


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def upsert_into(collections: Collections, name: str, key: str, order: list[str]):
    """A function for ``foreachBatch`` that folds a batch into a collection.

    Each batch makes one version, named after the batch, so a batch that is
    run again after a failure does nothing new.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        known = collections.versions(name)
        if known and known[-1] > batch_id:
            return
        last = latest(batch, key, order)
        collections.write(name, upsert(collections.read(name), last, key) if known else last)

    return run


def start_upserts(stream: DataFrame, collections: Collections, name: str, key: str, order: list[str], checkpoint: str):
    return stream.writeStream.foreachBatch(upsert_into(collections, name, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def click_counts(stream: DataFrame, by: list[str]) -> DataFrame:
    """Running counts, for ``complete`` or ``update`` output; the state has a row for each group."""
    return stream.groupBy(*by).agg(F.count("*").alias("count"))


def windowed_counts(stream: DataFrame, when: str, by: list[str], length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window of event time; the watermark bounds the state. An extra beyond the reference's operators."""
    out = stream.withWatermark(when, late).groupBy(F.window(when, length).alias("w"), *by).agg(F.count("*").alias("count"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "count")


def click_rates(stream: DataFrame, by: str, clicked: str) -> DataFrame:
    """(by, views, clicks, ctr) after each batch, with state of two numbers a key."""
    import pandas as pd

    def step(key, groups, state):
        views, clicks = state.get if state.exists else (0, 0)
        for g in groups:
            views, clicks = views + len(g), clicks + int(g[clicked].sum())
        state.update((views, clicks))
        yield pd.DataFrame({by: [key[0]], "views": [views], "clicks": [clicks], "ctr": [clicks / views]})

    kind = dict(stream.dtypes)[by]
    return stream.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, views long, clicks long, ctr double", "views long, clicks long", "update", "NoTimeout")


def sessions(events: DataFrame, user: str, when: str, gap_seconds: int = 1800) -> DataFrame:
    """(user, session, start, end, events) of a batch: a gap starts a new session. An extra."""
    w = W.partitionBy(user).orderBy(when)
    new = F.coalesce((F.unix_micros(when) - F.unix_micros(F.lag(when).over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    each = events.withColumn("_n", new).withColumn("session", F.sum("_n").over(w))
    return each.groupBy(user, "session").agg(F.min(when).alias("start"), F.max(when).alias("end"), F.count("*").alias("events"))


def start_click_models(stream: DataFrame, collections: Collections, name: str, by: str, order: str, checkpoint: str, features: str = "features", clicked: str = "clicked"):
    """Feedback (by, features, clicked, order) learnt batch by batch into the stored models of ``name``; a batch that is run again does nothing new."""
    from quarry.operators import ads

    def learn(batch: DataFrame, batch_id: int) -> None:
        known = collections.versions(name)
        if known and known[-1] > batch_id:
            return
        learnt = ads.train_click_models(batch, by, order, features, clicked, collections.read(name) if known else None)
        collections.write(name, learnt)

    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
