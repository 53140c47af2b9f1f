"""Metadata filters: a small expression tree that compiles to one boolean column.

Logic has two values. A leaf over a missing (null) field is false, with ne as well, and not_ turns that into true.
Numbers compare across types, strings by bytes; values of other types than the field's are never equal to it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = ("gt", "gte", "lt", "lte")
OPS = ("eq", "ne", *ORDERED, "in", "between", "exists", "contains")


class Filter:
    """Base of all filters; & | ~ combine them."""

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Leaf(Filter):
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


@dataclass(frozen=True)
class Field:
    """field("price").lt(10) and so on."""

    name: str

    def eq(self, value):
        return Leaf(self.name, "eq", value)

    def ne(self, value):
        return Leaf(self.name, "ne", value)

    def gt(self, value):
        return Leaf(self.name, "gt", value)

    def gte(self, value):
        return Leaf(self.name, "gte", value)

    def lt(self, value):
        return Leaf(self.name, "lt", value)

    def lte(self, value):
        return Leaf(self.name, "lte", value)

    def in_(self, values):
        return Leaf(self.name, "in", tuple(values))

    def between(self, low, high):
        return Leaf(self.name, "between", (low, high))

    def exists(self):
        return Leaf(self.name, "exists")

    def contains(self, value):
        return Leaf(self.name, "contains", value)


field = Field


def _family(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "list" if isinstance(value, (list, tuple)) else "other"


def _family_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    return "string" if isinstance(kind, T.StringType) else "list" if isinstance(kind, T.ArrayType) else "other"


def _equal(column: Column, kind: T.DataType, value: Any) -> Column:
    if _family(value) != _family_of(kind):
        return F.lit(False)
    if isinstance(value, (list, tuple)):
        return column == F.array(*[F.lit(v) for v in value]) if value else F.size(column) == 0
    if isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    return column == F.lit(value)


def _leaf(leaf: Leaf, kind: T.DataType) -> Column:
    column, op, value = F.col(f"`{leaf.field}`"), leaf.op, leaf.value
    if op == "exists":
        return column.isNotNull()
    if op == "eq":
        out = _equal(column, kind, value)
    elif op == "ne":
        return column.isNotNull() & ~F.coalesce(_equal(column, kind, value), F.lit(False))
    elif op == "in":
        out = reduce(Column.__or__, [F.coalesce(_equal(column, kind, v), F.lit(False)) for v in value], F.lit(False))
    elif op == "contains":
        family = _family_of(kind)
        out = F.array_contains(column, value) if family == "list" else column.contains(value) if family == "string" else F.lit(False)
    elif op == "between":
        out = _leaf(Leaf(leaf.field, "gte", value[0]), kind) & _leaf(Leaf(leaf.field, "lte", value[1]), kind)
    elif _family(value) != _family_of(kind) or _family(value) not in ("number", "string") or isinstance(value, float) and math.isnan(value):
        out = F.lit(False)
    else:
        out = {"gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            out = out & ~F.isnan(column)  # Spark orders NaN above all numbers
    return F.coalesce(out, F.lit(False))


def compiled(expression: Filter | None, schema: T.StructType) -> Column:
    """One boolean column over rows of schema; a field that schema lacks is missing in every row."""
    if expression is None:
        return F.lit(True)
    if isinstance(expression, And):
        return reduce(Column.__and__, [compiled(p, schema) for p in expression.parts], F.lit(True))
    if isinstance(expression, Or):
        return reduce(Column.__or__, [compiled(p, schema) for p in expression.parts], F.lit(False))
    if isinstance(expression, Not):
        return ~compiled(expression.part, schema)
    return _leaf(expression, schema[expression.field].dataType) if expression.field in schema.names else F.lit(False)


def fields(expression: Filter | None) -> list[str]:
    """The fields that a filter names, sorted, each once."""
    if expression is None:
        return []
    if isinstance(expression, Leaf):
        return [expression.field]
    parts = [expression.part] if isinstance(expression, Not) else expression.parts
    return sorted({f for p in parts for f in fields(p)})


def parsed(node: Mapping[str, Any]) -> Filter:
    """A filter from its JSON form: {"and": [...]}, {"or": [...]}, {"not": ...} or {"field", "op", "value" or "values"}."""
    if "and" in node:
        return And(tuple(map(parsed, node["and"])))
    if "or" in node:
        return Or(tuple(map(parsed, node["or"])))
    if "not" in node:
        return Not(parsed(node["not"]))
    if "field" not in node or "op" not in node:
        raise ValueError("a filter needs and, or, not, or field and op")
    op, name = str(node["op"]).lower(), node["field"]
    if op not in OPS:
        raise ValueError(f"unknown filter operation {op!r}")
    if op == "exists":
        return Leaf(name, op)
    if op == "in":
        return Leaf(name, op, tuple(node.get("values", node.get("value", ()))))
    if op == "between":
        values = tuple(node.get("values", node.get("value", ())))
        if len(values) != 2:
            raise ValueError("between needs two values")
        return Leaf(name, op, values)
    if "value" not in node:
        raise ValueError(f"{op} needs a value")
    if op == "contains" and not isinstance(node["value"], str):
        raise ValueError("contains needs a string")
    return Leaf(name, op, node["value"])


# Fixed shares that a planner assumes, whatever it knows of the field.
FIXED_SHARES = {"gt": 0.33, "gte": 0.33, "lt": 0.33, "lte": 0.33, "between": 0.10, "contains": 0.10}


def selectivity(expression: Filter, distinct: Mapping[str, int], filled: Mapping[str, int], total: int) -> float:
    """The assumed share of rows that pass, from each field's distinct values and filled rows; 1 for a leaf that needs them where nothing is known."""
    if total == 0:
        return 1.0
    if isinstance(expression, And):
        out = 1.0
        for p in expression.parts:
            out *= selectivity(p, distinct, filled, total)
    elif isinstance(expression, Or):
        out = 0.0
        for p in expression.parts:
            s = selectivity(p, distinct, filled, total)
            out = out + s - out * s
    elif isinstance(expression, Not):
        out = 1 - selectivity(expression.part, distinct, filled, total)
    elif expression.op in FIXED_SHARES:
        out = FIXED_SHARES[expression.op]
    elif expression.field not in distinct:
        return 1.0
    elif expression.op == "exists":
        out = filled.get(expression.field, total) / total
    elif not (u := distinct[expression.field]):
        return 1.0
    else:
        out = len(expression.value) / u if expression.op == "in" else 1 - 1 / u if expression.op == "ne" else 1 / u
    return min(max(out, 0.001), 1.0)
