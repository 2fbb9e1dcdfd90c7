"""Sort keys, ties and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 20


def sort_columns(keys: list[dict | str], known: list[str], tie: str, default: str | None = None) -> list[Column]:
    """Columns for [{"property", "order"}]: ascending by default, nulls lowest, unknown keys dropped, ties to the larger id.

    Without a usable key ``default`` (a score) sorts, largest first.
    """
    out = []
    for k in keys or []:
        name, order = (k, "asc") if isinstance(k, str) else (k["property"], str(k.get("order", "ASC")).lower())
        if name in known:
            out.append(F.col(name).asc_nulls_first() if order == "asc" else F.col(name).desc_nulls_last())
    if not out and default:
        out = [F.col(default).desc_nulls_last()]
    return [*out, F.col(tie).desc()]


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = LIMIT) -> DataFrame:
    """One page; offset and limit become a bounded top-k."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def random_order(df: DataFrame, key: str, seed: int) -> list[Column]:
    """A shuffle that is the same for the same seed, whatever the partitions."""
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
