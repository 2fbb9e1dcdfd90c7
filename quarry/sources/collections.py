"""Named collections below one folder: a table of Parquet files each, with versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Collections:
    """Creates, reads, replaces and drops collections. A new version is a new folder, so readers keep theirs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        where = self._path(f"{self.root}/{name}")
        if not self._fs.exists(where):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(v[1:]) for v in found if v.startswith("v") and self._fs.exists(self._path(f"{self.root}/{name}/{v}/_SUCCESS")))

    def names(self) -> list[str]:
        where = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, name: str) -> DataFrame:
        found = self.versions(name)
        if not found:
            raise ValueError(f"no collection {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{found[-1]}")

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        version = max(self.versions(name), default=0) + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v{version}")
        return version

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Settings:
    """Small tables that are set and read by key, each a collection: a later value for a key replaces the earlier."""

    def __init__(self, collections: Collections, name: str, keys: list[str]):
        self.collections, self.name, self.keys = collections, name, keys

    def set(self, rows: DataFrame) -> int:
        """Add rows, which replace those with their keys (nulls are keys too); returns the version."""
        new = rows
        if self.collections.versions(self.name):
            old = self.collections.read(self.name)
            known = rows.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
            same = F.lit(True)
            for k in self.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            new = old.join(known, same, "left_anti").unionByName(rows)
        return self.collections.write(self.name, new)

    def get(self, **keys) -> DataFrame:
        out = self.collections.read(self.name)
        for k, v in keys.items():
            out = out.filter(F.col(k).eqNullSafe(F.lit(v)))
        return out


def merchant_scores(collections: Collections) -> Settings:
    """(merchant, category, score); a null category is the general score."""
    return Settings(collections, "merchant_scores", ["merchant", "category"])


def custom_ranks(collections: Collections) -> Settings:
    """(query, pinned, excluded): what a query shows first, and never."""
    return Settings(collections, "custom_ranks", ["query"])


def label_knowledge(collections: Collections) -> Settings:
    """(source, labels): labels that queries from a source are known for."""
    return Settings(collections, "label_knowledge", ["source"])


class Watched:
    """A dictionary file that is read again when it has changed."""

    def __init__(self, spark: SparkSession, path: str, load):
        self.spark, self.path, self.load, self.stamp, self.value = spark, path, load, None, None

    def get(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        status = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        stamp = (status.getModificationTime(), status.getLen())
        if stamp != self.stamp:
            self.value, self.stamp = self.load(self.spark, self.path), stamp
        return self.value
