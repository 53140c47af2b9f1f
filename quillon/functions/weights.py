"""Effective edge weights and validity in time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_WEIGHT = 1e-6
LEAST_COST, MOST_COST = 1e-6, 1e12


@dataclass(frozen=True)
class Weight:
    """What an edge's weight is made of; nothing set gives 1.

    min_confidence is a floor under the confidence, not a filter. half_life_ms halves the weight with each such age.
    """

    property: str | None = None
    use_confidence: bool = False
    min_confidence: float | None = None
    half_life_ms: float | None = None

    def nothing(self) -> bool:
        return not (self.property or self.use_confidence or self.min_confidence is not None or self.half_life_ms)


@dataclass(frozen=True)
class Temporal:
    """Edges valid at as_of (or now); edges without bounds pass if include_unbounded; context, if given, must match."""

    as_of: int | None = None
    include_unbounded: bool = True
    context: str | None = None


def explicit_weight(name: str) -> Column:
    """A positive finite number, or a string that holds one, under a key of the properties; else 1."""
    if set(name) & set("'\"\\[]"):  # which the plain path can't hold
        path = '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'
        found = F.try_variant_get(F.try_parse_json("properties"), path, "string")
    else:
        found = F.get_json_object("properties", f"$['{name}']")
    item = found.try_cast("double")
    return F.when((item > 0) & (item < float("inf")), item).otherwise(F.lit(1.0))


def effective_weight(weight: Weight, now_ms: int) -> Column:
    if weight.nothing():
        return F.lit(1.0)
    out = explicit_weight(weight.property) if weight.property else F.lit(1.0)
    if weight.use_confidence or weight.min_confidence is not None:
        out = out * F.least(F.greatest(F.col("confidence").cast("double"), F.lit(float(weight.min_confidence or 0.0))), F.lit(1.0))
    if weight.half_life_ms:
        age = F.greatest(F.lit(float(now_ms)) - F.col("created_at").cast("double"), F.lit(0.0))
        out = out * F.pow(F.lit(2.0), -age / float(weight.half_life_ms))
    return F.greatest(out, F.lit(LEAST_WEIGHT))


def cost(weight: Column) -> Column:
    return F.least(F.greatest(1 / weight, F.lit(LEAST_COST)), F.lit(MOST_COST))


def valid(temporal: Temporal | None, now_ms: int) -> Column:
    if temporal is None:
        return F.lit(True)
    at = F.lit(now_ms if temporal.as_of is None else temporal.as_of)
    start, end = F.col("valid_from"), F.col("valid_until")
    within = (start.isNull() | (start <= at)) & (end.isNull() | (at < end))
    out = F.when(start.isNull() & end.isNull(), F.lit(temporal.include_unbounded)).otherwise(within)
    if temporal.context is not None:
        out = F.coalesce(F.col("temporal_context") == temporal.context, F.lit(False)) & out
    return out
