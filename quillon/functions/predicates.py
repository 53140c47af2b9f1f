"""Graph predicates over nodes and edges whose properties are a JSON string.

Logic has two values, and a property that is missing fails every comparison, not_in and ne included. Numbers compare as
doubles, strings by bytes, other types only for equality. Exists holds for a JSON null too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return All((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Any_((self, other))

    def __invert__(self) -> Predicate:
        return Negated(self)


@dataclass(frozen=True)
class Property:
    name: str


@dataclass(frozen=True)
class Label:
    """An entity node's label, an edge's type."""


@dataclass(frozen=True)
class Kind:
    """A node's kind."""


@dataclass(frozen=True)
class IncidentEdges:
    """How many edges a node has; a loop counts once even for both directions."""

    edge_type: str | None = None
    direction: str = "outgoing"


@dataclass(frozen=True)
class Compare(Predicate):
    ref: Property | Label | Kind | IncidentEdges
    op: str  # eq ne lt le gt ge
    value: Any


@dataclass(frozen=True)
class Among(Predicate):
    ref: Property | Label | Kind | IncidentEdges
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Exists(Predicate):
    ref: Property | Label | Kind | IncidentEdges


@dataclass(frozen=True)
class All(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Any_(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Negated(Predicate):
    part: Predicate


@dataclass(frozen=True)
class Always(Predicate):
    pass


def references(predicate: Predicate | None) -> list:
    if predicate is None or isinstance(predicate, Always):
        return []
    if isinstance(predicate, (All, Any_)):
        return [r for p in predicate.parts for r in references(p)]
    return references(predicate.part) if isinstance(predicate, Negated) else [predicate.ref]


def degree_column(ref: IncidentEdges) -> str:
    """The name under which a node's count of such edges is expected."""
    return f"degree_{ref.direction}_{ref.edge_type or ''}"


def _path(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def _value(ref, value: Any) -> tuple[Column, Column]:
    """(the reference's value as value's type, whether it has that type); both null or false where it is missing."""
    family = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "other"
    if isinstance(ref, Property):
        item = F.try_variant_get(F.try_parse_json("properties"), _path(ref.name), "variant")
        kind = F.schema_of_variant(item)
        if family == "number":
            return item.cast("double"), kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        if family == "bool":
            return item.cast("boolean"), kind == "BOOLEAN"
        if family == "string":
            return item.cast("string"), kind == "STRING"
        return F.to_json(item), kind.isNotNull()
    if isinstance(ref, IncidentEdges):
        return F.col(degree_column(ref)).cast("double"), F.lit(family == "number")
    return F.col("label") if isinstance(ref, Label) else F.col("kind"), F.lit(family == "string")


def _exists(ref) -> Column:
    if isinstance(ref, Property):
        return F.coalesce(F.array_contains(F.json_object_keys("properties"), ref.name), F.lit(False))
    return F.lit(True) if isinstance(ref, IncidentEdges) else _value(ref, "")[0].isNotNull()


def _literal(value: Any) -> Column:
    if value is None or isinstance(value, (list, tuple, dict)):
        import json

        return F.lit(json.dumps(value, separators=(",", ":")))
    return F.lit(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else F.lit(value)


def _equal(ref, value: Any) -> Column:
    item, typed = _value(ref, value)
    return F.coalesce(typed & (item == _literal(value)), F.lit(False))


def compiled(predicate: Predicate | None) -> Column:
    """A boolean column over rows with label, kind, properties and the degree columns that the predicate needs."""
    if predicate is None or isinstance(predicate, Always):
        return F.lit(True)
    if isinstance(predicate, All):
        return reduce(Column.__and__, map(compiled, predicate.parts), F.lit(True))
    if isinstance(predicate, Any_):
        return reduce(Column.__or__, map(compiled, predicate.parts), F.lit(False))
    if isinstance(predicate, Negated):
        return ~compiled(predicate.part)
    if isinstance(predicate, Exists):
        return _exists(predicate.ref)
    if isinstance(predicate, Among):
        hit = reduce(Column.__or__, [_equal(predicate.ref, v) for v in predicate.values], F.lit(False))
        return _exists(predicate.ref) & ~hit if predicate.negated else hit
    if predicate.op == "eq":
        return _equal(predicate.ref, predicate.value)
    if predicate.op == "ne":
        return _exists(predicate.ref) & ~_equal(predicate.ref, predicate.value)
    if isinstance(predicate.value, bool) or not isinstance(predicate.value, (int, float, str)):
        return F.lit(False)
    item, typed = _value(predicate.ref, predicate.value)
    other = _literal(predicate.value)
    out = {"lt": item < other, "le": item <= other, "gt": item > other, "ge": item >= other}[predicate.op]
    return F.coalesce(typed & out, F.lit(False))
