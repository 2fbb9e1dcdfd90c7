"""Tagged-text ingest files: ``<DOCID>..`` starts a document, ``<Name>..`` a field, which may span lines.

Names read ``B-<collector>-<yyyyMMddHHmm>-<ssSSS>-<I|U|D>-<C>.SCD``; the letter,
of any case, says whether documents are inserted, updated or deleted.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAME = re.compile(r"B-(\d+)-(\d{12})-(\d{5})-([IUDRiudr])-([A-Za-z])\.SCD", re.I)
KINDS = {"I": "insert", "U": "update", "D": "delete", "R": "rtype"}


def parse_name(name: str) -> dict:
    m = NAME.fullmatch(name.rsplit("/", 1)[-1])
    if not m:
        raise ValueError(f"not an ingest file: {name}")
    return {"collector": int(m[1]), "time": datetime.strptime(m[2], "%Y%m%d%H%M"), "sequence": int(m[3]), "kind": KINDS[m[4].upper()]}


def read(spark: SparkSession, path: str, key: str = "DOCID") -> DataFrame:
    """(DOCID, fields map<string,string>, kind, stamp, position): documents of all files below ``path``.

    A file is cut at its key tags by the reader itself, so large files are
    split among tasks and one record is in memory at a time. ``stamp`` is the
    order of files by name, ``position`` that of documents in a file.
    """
    raw = spark.read.option("lineSep", f"<{key}>").option("recursiveFileLookup", "true").text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(?i)^B-\d+-(\d{12})-(\d{5})-([IUDR])-[A-Z]\.SCD$", 0)
    part = lambda n: F.regexp_extract(F.col("_metadata.file_name"), r"(?i)^B-\d+-(\d{12})-(\d{5})-([IUDR])-[A-Z]\.SCD$", n)
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    docs = raw.select("value", name.alias("name"), F.element_at(kinds, F.upper(part(3))).alias("kind"), F.concat(part(1), part(2)).alias("stamp"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("position"))
    docs = docs.filter((F.col("name") != "") & (F.trim("value") != ""))
    cells = F.split("value", r"(?m)^<(?=\w+>)")
    fields = F.transform(F.slice(cells, 2, 1_000_000), lambda c: F.struct(F.regexp_extract(c, r"^(\w+)>", 1).alias("k"), F.regexp_replace(F.regexp_replace(c, r"^\w+>", ""), r"\s+$", "").alias("v")))
    last = F.map_from_entries(F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, i + 2, F.lit(1_000_000)), lambda g: g["k"] == f["k"])))
    return docs.select(F.regexp_replace(F.element_at(cells, 1), r"\s+$", "").alias(key), last.alias("fields"), "kind", "stamp", "position")


def to_records(df: DataFrame, key: str = "DOCID") -> DataFrame:
    """One text column: each row as a tagged record. Null fields are left out."""
    parts = [F.concat(F.lit(f"<{key}>"), F.col(key).cast("string"))]
    parts += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n<{c}>"), F.col(c).cast("string"))) for c in df.columns if c != key]
    return df.select(F.concat_ws("", *parts).alias("value"))


def write(df: DataFrame, path: str, key: str = "DOCID") -> None:
    to_records(df, key).write.text(path)


def file_name(kind: str, collector: int, when: datetime, sequence: int) -> str:
    letter = {v: k for k, v in KINDS.items()}[kind]
    return f"B-{collector:02d}-{when:%Y%m%d%H%M}-{sequence:05d}-{letter}-C.SCD"


def write_kind(df: DataFrame, path: str, kind: str, collector: int = 0, when: datetime | None = None, key: str = "DOCID") -> list[str]:
    """Write rows as ingest files named by their kind, one for each partition; returns the names."""
    spark, when = df.sparkSession, when or datetime.now()
    write(df, f"{path}/_{kind}", key)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source = hadoop(f"{path}/_{kind}")
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen())
    names = [file_name(kind, collector, when, k) for k in range(len(parts))]
    for part, name in zip(parts, names, strict=True):
        fs.rename(hadoop(source, part), hadoop(path, name))
    fs.delete(source, True)
    return names


def write_index(records: DataFrame, path: str, key: str = "DOCID", slots: int = 64) -> None:
    """Store records in folders by a hash of their key, for access by key."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    records.withColumn("_slot", slot).repartition("_slot").sortWithinPartitions("_slot", key).write.partitionBy("_slot").parquet(path)


def look_up(spark: SparkSession, path: str, keys: list[str], key: str = "DOCID", slots: int = 64) -> DataFrame:
    """Stored records of some keys; only their folders are read."""
    found = spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k)), F.lit(slots)).cast("int") for k in keys]))).collect()
    return spark.read.parquet(path).filter(F.col("_slot").isin([r[0] for r in found]) & F.col(key).isin(keys)).drop("_slot")


def merge(records: DataFrame, key: str = "DOCID") -> DataFrame:
    """Each key's state after all records in order: (DOCID, fields, kind).

    An insert replaces what was there, an update adds its fields to it, a
    delete removes it; fields of later records win. ``kind`` is update where only
    updates are known, insert where a document is whole. Keys whose last record is
    a delete stay with kind ``delete``, for stores that hold them.
    """
    order = W.partitionBy(key).orderBy("stamp", "position")
    starts = F.sum(F.when(F.col("kind").isin("insert", "delete"), 1).otherwise(0)).over(order)
    marked = records.withColumn("_era", starts).withColumn("_last", F.max("_era").over(W.partitionBy(key))).filter("_era = _last")
    each = marked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stamp", "position", "kind", F.map_entries("fields").alias("fields")))).alias("r"))
    fold = F.aggregate("r", F.create_map().cast("map<string,string>"), lambda a, x: F.map_concat(F.map_filter(a, lambda k, _: ~F.exists(x["fields"], lambda f: f["key"] == k)), F.map_from_entries(x["fields"])))
    return each.select(key, fold.alias("fields"), F.when(F.element_at("r", 1)["kind"] == "delete", F.when(F.size("r") == 1, "delete").otherwise("insert")).otherwise(F.element_at("r", 1)["kind"]).alias("kind"))


def typed(merged: DataFrame, columns: dict[str, str], key: str = "DOCID") -> DataFrame:
    """Fields as columns of the given types; what can't be read as its type is null."""
    from quarry.functions.paths import timestamp

    def cast(name: str, kind: str) -> Column:
        text = F.col("fields")[name]
        return timestamp(text) if kind == "timestamp" else text.try_cast(kind)

    return merged.select(key, "kind", *[cast(c, t).alias(c) for c, t in columns.items()])
