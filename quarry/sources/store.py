"""Changing a stored collection: upserts, deletes, changes in place, and files of JSON or queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's last row by ``order``."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with ``changes`` (one row a key): new keys are added; where a change is null the stored value stays."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    cols = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c) for c in stored.columns if c != key]
    return stored.join(new, key, "full").select(key, *cols)


def update_kinds(stored: DataFrame, changes: DataFrame, key: str, in_place: list[str]) -> DataFrame:
    """(key, kind) of each change: INSERT for new keys, RTYPE if only columns that need no analysis differ, GENERAL else, NOCHANGE if none does."""
    old = stored.select(F.col(key), F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in stored.columns if c != key])
    both = changes.join(old, key, "left")
    differs = lambda cols: F.array_contains(F.array(F.lit(False), *[F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols if c in changes.columns]), True)
    other = [c for c in stored.columns if c != key and c not in in_place]
    kind = F.when(F.col("_known").isNull(), "INSERT").when(differs(other), "GENERAL").when(differs(in_place), "RTYPE").otherwise("NOCHANGE")
    return both.select(key, kind.alias("kind"))


def add_in_place(stored: DataFrame, deltas: DataFrame, key: str, column: str) -> DataFrame:
    """Numbers moved by ``delta``; a missing number counts as 0."""
    d = deltas.groupBy(key).agg(F.sum("delta").alias("_d"))
    kind = dict(stored.dtypes)[column]
    return stored.join(d, key, "left").withColumn(column, F.when(F.col("_d").isNotNull(), F.coalesce(F.col(column), F.lit(0)) + F.col("_d")).otherwise(F.col(column)).cast(kind)).drop("_d")


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def get(df: DataFrame, condition: dict) -> DataFrame:
    """Rows by id or another property: exactly one condition, with ``=`` or ``in``."""
    from quarry.operators import conditions

    if conditions.ALIASES.get(str(condition.get("operator", "=")).lower()) not in ("=", "in"):
        raise ValueError("documents are got by = or in")
    return df.filter(conditions.condition([{"operator": "=", **condition}], df.schema))


def get_by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in a table of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_duplicates(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row, that with the smallest key, of those that agree in some columns."""
    rest = [c for c in df.columns if c not in columns]
    return df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.col(key)).alias("_r")).select(*columns, "_r.*").select(*df.columns)


def write_log(df: DataFrame, url: str, name: str, **options) -> None:
    """Append rows to a log table of a relational store."""
    df.write.jdbc(url, name, mode="append", properties={k: str(v) for k, v in options.items()})


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Documents as lines of JSON; what doesn't fit the schema is null."""
    return spark.read.schema(schema).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, category, freq) of tab-separated files."""
    return spark.read.option("sep", "\t").schema("query string, category string, freq long").csv(path)


def read_log(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A log table of a relational store; its driver must be on the class path."""
    return spark.read.jdbc(url, name, properties={k: str(v) for k, v in options.items()})


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Rewrite a table as so many files of rows."""
    spark.read.parquet(source).repartition(files).write.parquet(target)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save as a table dealt and sorted by its key, so that joins on it need no exchange."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def subdocuments(text) -> F.Column:
    """JSON text of a list of objects as array<map<string,string>>."""
    return F.from_json(text, "array<map<string,string>>")
