"""Nearest rows by SimHash: equal bits of a signature of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 63


def simhash(tokens: Column) -> Column:
    """A number with a bit set where more than half of the words' hashes have it; 0 for no words."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    none = F.array_repeat(F.lit(0), BITS)
    counts = F.aggregate(hashes, none, lambda a, h: F.transform(a, lambda v, i: v + F.getbit(h, i).cast("int")))
    return F.aggregate(F.transform(counts, lambda v, i: F.when(2 * v > F.size(tokens), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))


def nearest(df: DataFrame, signature: str, wanted: int, k: int, key: str, most: int = BITS) -> DataFrame:
    """The ``k`` rows whose signature differs from ``wanted`` in fewest bits, at most ``most``; ties by key."""
    apart = F.bit_count(F.col(signature).bitwiseXOR(F.lit(wanted)))
    return df.withColumn("apart", apart).filter(F.col("apart") <= most).orderBy("apart", key).limit(k)
