"""Category paths, attribute lists, dates and ranges as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_paths(text: Column) -> Column:
    """``A>B>C,D>E`` (or with ``;``) as array<array<string>>; empty nodes and paths go, blanks around nodes too.

    A value in double quotes may hold separators; a doubled quote in it is one.
    """
    # Quoted values are taken out first: separators inside them become control characters, put back at the end.
    shielded = F.aggregate(
        F.split(F.coalesce(text, F.lit("")), '"'),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("i")),
        lambda a, x: F.struct(F.concat(a["s"], F.when(a["i"] % 2 == 0, x).otherwise(F.translate(x, ",;>", "\x01\x02\x03")), F.when((a["i"] % 2 == 0) & (a["i"] > 0) & (x == ""), F.lit("")).otherwise("")).alias("s"), (a["i"] + 1).alias("i")),
        lambda a: a["s"],
    )
    node = lambda x: F.translate(F.trim(x), "\x01\x02\x03", ",;>")
    path = lambda p: F.filter(F.transform(F.split(p, ">"), node), lambda n: n != "")
    return F.filter(F.transform(F.split(shielded, "[,;]"), path), lambda p: F.size(p) > 0)


def prefixes(path: Column) -> Column:
    """All ancestors of a path and itself, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, 1, n))


def attributes(text: Column) -> Column:
    """``name:v1|v2,name2:v`` as array<struct<name, values>>; pairs without a name or value go."""
    pair = lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("name"), F.filter(F.transform(F.split(F.regexp_replace(p, r"^[^:]*:?", ""), r"\|"), lambda v: F.trim(v)), lambda v: v != "").alias("values"))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), pair), lambda a: (a["name"] != "") & (F.size(a["values"]) > 0))


def timestamp(text: Column) -> Column:
    """API dates (2012-07-04, with or without time) and ingest dates (20120704143015); null for anything else."""
    digits = F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))
    day = F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    long = F.try_to_timestamp(F.translate(text, "/T", "- "), F.lit("yyyy-MM-dd HH:mm:ss"))
    short = F.try_to_timestamp(F.translate(text, "/", "-"), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.when(text.rlike(r"^\d{14}$"), digits), F.when(text.rlike(r"^\d{8}$"), day), F.when(text.rlike(r"^\d{4}[-/]\d\d[-/]\d\d[ T]\d\d:\d\d:\d\d$"), long), F.when(text.rlike(r"^\d{4}[-/]\d\d[-/]\d\d$"), short))


DATE_UNITS = {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd"}


def date_label(when: Column, unit: str) -> Column:
    return F.date_format(when, DATE_UNITS[unit])


def label_unit(label: str) -> str:
    for unit, shape in (("Y", r"\d{4}"), ("M", r"\d{4}-\d\d"), ("D", r"\d{4}-\d\d-\d\d")):
        if re.fullmatch(shape, label):
            return unit
    raise ValueError(f"not a date label: {label}")


def number_range(text: Column, kind: str = "double") -> Column:
    """``a-b``, ``a~b`` or ``a,b`` as struct<lo, hi>, swapped if need be; one number is both."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    lo = F.regexp_extract(text, f"^{number}", 1)
    hi = F.regexp_extract(text, f"^{number}[-~,]{number}$", 2)
    a = F.when(lo != "", lo).cast(kind)
    b = F.coalesce(F.when(hi != "", hi).cast(kind), a)
    return F.when(a.isNotNull(), F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def byte_size(text: str) -> int:
    """``10``, ``10k``, ``1.5MB``, ``2g`` ... in bytes."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)b?\s*", text.lower())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2] or " "))


def merchant_names(text: Column) -> Column:
    """Names in a list parted by commas or semicolons, without blanks around and without repeats."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda n: F.trim(n))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def round_down(value: Column, unit: int) -> Column:
    return F.floor(value / F.lit(unit)) * unit


def round_up(value: Column, unit: int) -> Column:
    return F.ceil(value / F.lit(unit)) * unit
