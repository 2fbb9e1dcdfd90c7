"""Collections: a table and what may be done with each of its properties."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Declared type names and the Spark types they stand for.
TYPES = {
    "string": T.StringType(), "subdoc": T.ArrayType(T.MapType(T.StringType(), T.StringType())), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(),
    "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "datetime": T.TimestampType(),
}
NUMERIC = ("int8", "int16", "int32", "int64", "float", "double", "datetime")


@dataclass(frozen=True)
class Property:
    """One declared property; flags say what it may be used for."""

    name: str
    type: str = "string"
    index: bool = True
    filter: bool = True
    group: bool = False
    attr: bool = False
    suffix: bool = False
    multivalue: bool = False
    range: bool = False
    summary: bool = False
    snippet: bool = False
    highlight: bool = False
    rank_weight: float = 1.0
    parts: tuple[str, ...] = ()  # of a virtual property

    def spark_type(self) -> T.DataType:
        base = TYPES[self.type]
        if self.range:
            return T.StructType([T.StructField("lo", base), T.StructField("hi", base)])
        return T.ArrayType(base) if self.multivalue else base


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    key: str
    properties: tuple[Property, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [p.name for p in self.properties]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name} declares a property twice")
        if self.key not in names:
            raise ValueError(f"{self.name} lacks its key {self.key}")
        for p in self.properties:
            if p.type not in TYPES:
                raise ValueError(f"{p.name}: unknown type {p.type}")
            if missing := set(p.parts) - set(names):
                raise ValueError(f"{p.name}: unknown parts {sorted(missing)}")

    def get(self, name: str) -> Property:
        for p in self.properties:
            if p.name == name:
                return p
        raise ValueError(f"{self.name} has no property {name}")

    def has(self, name: str) -> bool:
        return any(p.name == name for p in self.properties)

    def sortable(self, name: str) -> bool:
        return name in ("_rank", "custom_rank", "geo_rank", "date") or (self.has(name) and not self.get(name).multivalue and not self.get(name).range and (self.get(name).type in NUMERIC or self.get(name).filter))

    def filterable(self, name: str) -> bool:
        return self.has(name) and self.get(name).index and self.get(name).filter

    def searchable(self) -> list[str]:
        return [p.name for p in self.properties if p.type == "string" and p.index and not p.multivalue]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, p.spark_type(), True, {k: v for k, v in vars(p).items() if k not in ("name", "parts")}) for p in self.properties if not p.parts])

    @classmethod
    def of(cls, name: str, key: str, df: DataFrame, **flags: dict) -> CollectionSchema:
        """Declare what ``df`` has; ``flags`` are further arguments by property."""
        kinds = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime"}
        props = []
        for c, t in df.dtypes:
            many = t.startswith("array<")
            base = t[6:-1] if many else t
            props.append(Property(c, kinds.get(base, "string"), multivalue=many, **flags.get(c, {})))
        return cls(name, key, tuple(props))
