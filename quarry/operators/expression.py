"""Arithmetic ranking expressions, parsed into Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z_]\w*)|([-+*/(),]))")
FUNCTIONS = {"log": (1, F.log), "sqrt": (1, F.sqrt), "pow": (2, F.pow)}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        at = m.end()
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
    return out


class _Parser:
    def __init__(self, text: str, names: dict[str, Column]):
        self.rest, self.names = tokens(text), names

    def peek(self) -> str:
        return self.rest[0][1] if self.rest else ""

    def take(self, sign: str) -> None:
        if self.peek() != sign:
            raise ValueError(f"expected {sign!r}, found {self.peek()!r}")
        self.rest.pop(0)

    def total(self) -> Column:
        value = self.product()
        while self.peek() in ("+", "-"):
            sign = self.rest.pop(0)[1]
            other = self.product()
            value = value + other if sign == "+" else value - other
        return value

    def product(self) -> Column:
        value = self.factor()
        while self.peek() in ("*", "/"):
            sign = self.rest.pop(0)[1]
            other = self.factor()
            value = value * other if sign == "*" else F.try_divide(value, other)
        return value

    def factor(self) -> Column:
        if not self.rest:
            raise ValueError("the expression ends too soon")
        kind, text = self.rest.pop(0)
        if kind == "number":
            return F.lit(float(text))
        if text == "(":
            value = self.total()
            self.take(")")
            return value
        if text in "+-":
            value = self.factor()
            return -value if text == "-" else value
        if kind != "name":
            raise ValueError(f"unexpected {text!r}")
        if self.peek() == "(" and text.lower() in FUNCTIONS:
            count, make = FUNCTIONS[text.lower()]
            self.take("(")
            args = [self.total()]
            while self.peek() == ",":
                self.take(",")
                args.append(self.total())
            self.take(")")
            if len(args) != count:
                raise ValueError(f"{text} takes {count} arguments")
            return make(*args)
        if text not in self.names:
            raise ValueError(f"unknown name {text}")
        return self.names[text].cast("double")


def expression(text: str, properties: list[str], params: dict[str, object] | None = None) -> Column:
    """``text`` over numeric columns, in double precision.

    ``params`` binds names to constants (numbers) or properties (strings).
    Function names are case-insensitive, log is natural, x / 0 and the log of
    what isn't positive are null.
    """
    names = {p: F.col(p) for p in properties}
    for k, v in (params or {}).items():
        if isinstance(v, str) and v not in properties:
            raise ValueError(f"{k}: no property {v}")
        names[k] = F.col(v) if isinstance(v, str) else F.lit(float(v))
    p = _Parser(text, names)
    value = p.total()
    if p.rest:
        raise ValueError(f"unexpected {p.peek()!r}")
    return value
