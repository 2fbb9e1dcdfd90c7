"""Filter conditions: leaf operators, and/or trees, labels and access lists, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import paths

#: Names and aliases of the operators; fixed values.
ALIASES = {
    "=": "=", "equal": "=", "==": "=", "<>": "<>", "not_equal": "<>", "!=": "<>", "<": "<", "less_than": "<", "<=": "<=", "less_than_or_equal": "<=", ">": ">", "greater_than": ">",
    ">=": ">=", "greater_than_or_equal": ">=", "between": "between", "range": "between", "in": "in", "not_in": "not_in", "starts_with": "starts_with", "ends_with": "ends_with", "contains": "contains",
}
ARITY = {"between": (2, 2), "in": (1, None), "not_in": (1, None)}


def _one(op: str, c: Column, v: list) -> Column:
    match op:
        case "=":
            return c == v[0]
        case "<>":
            return c != v[0]
        case "<":
            return c < v[0]
        case "<=":
            return c <= v[0]
        case ">":
            return c > v[0]
        case ">=":
            return c >= v[0]
        case "between":
            return c.between(v[0], v[1])
        case "in":
            return c.isin(v)
        case "not_in":
            return ~c.isin(v)
        case "starts_with":
            return c.startswith(v[0])
        case "ends_with":
            return c.endswith(v[0])
    return c.contains(v[0])


def leaf(name: str, op: str, values, kind: T.DataType | None = None) -> Column:
    """One condition. Multi-valued properties match if any value does (``<>`` and ``not_in``: if none is equal).

    Range properties, struct<lo, hi>, match if some number in the range does.
    A null never matches.
    """
    key = ALIASES.get(op.lower())
    if key is None:
        raise ValueError(f"unknown operator {op}")
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    low, high = ARITY.get(key, (1, 1))
    if len(values) < low or (high is not None and len(values) > high):
        raise ValueError(f"{op} takes {low if high else f'{low} or more'} values, not {len(values)}")
    c = F.col(name)
    if isinstance(kind, T.ArrayType):
        if key in ("<>", "not_in"):
            return ~F.exists(c, lambda x: _one("in", x, values))
        return F.exists(c, lambda x: _one(key, x, values))
    if isinstance(kind, T.StructType):
        lo, hi = c["lo"], c["hi"]
        bounds = {"=": (values[0], values[0]), "between": tuple(values[:2]), "<": (None, values[0]), "<=": (None, values[0]), ">": (values[0], None), ">=": (values[0], None)}
        if key not in bounds:
            raise ValueError(f"{op} doesn't apply to the range {name}")
        a, b = bounds[key]
        above = F.lit(True) if a is None else (hi > a if key == ">" else hi >= a)
        below = F.lit(True) if b is None else (lo < b if key == "<" else lo <= b)
        return above & below
    return _one(key, c, values)


def condition(tree, schema: T.StructType | None = None) -> Column:
    """A tree of conditions.

    A leaf is {"property", "operator", "value"}; a node {"relation": "and" or
    "or", "condition_array": [...]}; a list is an "and". Nothing matches all.
    """
    if not tree:
        return F.lit(True)
    if isinstance(tree, list):
        tree = {"relation": "and", "condition_array": tree}
    if "condition_array" in tree:
        relation = str(tree.get("relation", "and")).lower()
        if relation not in ("and", "or"):
            raise ValueError(f"unknown relation {relation}")
        parts = [condition(t, schema) for t in tree["condition_array"]]
        if not parts:
            return F.lit(True)
        return reduce(lambda a, b: a & b if relation == "and" else a | b, parts)
    name = tree["property"]
    if schema is not None and name not in schema.names:
        raise ValueError(f"no property {name}")
    return leaf(name, tree["operator"], tree.get("value", []), schema[name].dataType if schema is not None else None)


def access(tokens: list[str], allow: str | None = "ACL_ALLOW", deny: str | None = "ACL_DENY") -> Column:
    """Rows that the bearer of ``tokens`` may see: allowed by one of them or for all, denied to none. Always ANDed."""
    out = F.lit(True)
    if allow:
        out = out & F.arrays_overlap(F.col(allow), F.array(*[F.lit(t) for t in [*tokens, "@@ALL@@"]]))
    if deny and tokens:
        out = out & ~F.coalesce(F.arrays_overlap(F.col(deny), F.array(*[F.lit(t) for t in tokens])), F.lit(False))
    return out


def path_label(c: Column, label: list[str]) -> Column:
    """Whether any path of array<array<string>> starts with the label."""
    wanted = F.array(*[F.lit(x) for x in label])
    return F.exists(c, lambda p: F.slice(p, 1, len(label)) == wanted)


def number_label(c: Column, labels: list[str]) -> Column:
    """Any of: a number, ``a-b``, ``a-`` or ``-b`` (inclusive; an open lower end takes positive numbers only)."""
    out = F.lit(False)
    for text in labels:
        a, dash, b = text.partition("-") if not text.startswith("-") else ("", "-", text[1:])
        if not dash:
            out = out | (c == float(a))
            continue
        part = c >= float(a) if a else c > 0
        out = out | (part & (c <= float(b)) if b else part)
    return out


def date_labels(c: Column, labels: list[str]) -> Column:
    """Any of the labels yyyy, yyyy-MM or yyyy-MM-dd; as ranges, so that scans are pruned."""
    out = F.lit(False)
    for text in labels:
        unit = paths.label_unit(text)
        first = F.lit(text + {"Y": "-01-01", "M": "-01", "D": ""}[unit]).cast("date").cast("timestamp")
        step = {"Y": "1 year", "M": "1 month", "D": "1 day"}[unit]
        out = out | ((c >= first) & (c < first + F.expr(f"interval {step}")))
    return out


def attr_label(c: Column, name: str, values: list[str]) -> Column:
    """Whether attributes, array<struct<name, values>>, have any of the values under the name."""
    wanted = F.array(*[F.lit(v) for v in values])
    return F.exists(c, lambda a: (a["name"] == name) & F.arrays_overlap(a["values"], wanted))
