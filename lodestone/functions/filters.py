"""The metadata filter tree, compiled to a Column over a VARIANT.

Leaves are two-valued: an absent field makes every comparison false, so ``not``
of it is true. A JSON null is present. Equality takes booleans for the numbers
0 and 1; order comparisons don't, and are false between different types.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "contains")
STRUCTURE = ("exists", "and", "or", "not")


class UnsupportedFilter(ValueError):
    """A backend cannot evaluate an operator of the filter."""


@dataclass(frozen=True)
class Filter:
    """A node: an operator, its field and value, or its parts."""

    op: str
    field: str | None = None
    value: object = None
    parts: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        return all_of(self, other)

    def __or__(self, other: Filter) -> Filter:
        return any_of(self, other)

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))

    def to_json(self) -> dict:
        if self.parts or self.op in ("and", "or"):
            return {"type": self.op, "parts": [p.to_json() for p in self.parts]}
        return {"type": self.op, "field": self.field} | ({} if self.op == "exists" else {"value": self.value})

    def operators(self) -> set[str]:
        return {self.op}.union(*(p.operators() for p in self.parts))


def from_json(node: dict) -> Filter:
    value = node.get("value")
    return Filter(node["type"], node.get("field"), value, tuple(map(from_json, node.get("parts", ()))))


def flattened(op: str, parts: tuple[Filter, ...]) -> Filter:
    return Filter(op, parts=tuple(q for p in parts for q in (p.parts if p.op == op else (p,))))


def all_of(*parts: Filter) -> Filter:
    return flattened("and", parts)


def any_of(*parts: Filter) -> Filter:
    return flattened("or", parts)


def none_of(*parts: Filter) -> Filter:
    return ~any_of(*parts)


class Field:
    """``Field("year").gte(2020)``."""

    def __init__(self, name: str):
        self.name = name

    def __getattr__(self, op: str):
        op = op.rstrip("_")
        if op not in COMPARISONS and op != "exists":
            raise AttributeError(op)
        return lambda value=None: Filter(op, self.name, value)


def validate_supported(node: Filter, supported: set[str], backend: str) -> None:
    """Raise for the first operator, by name, that the backend lacks; a clause is never left out."""
    if missing := sorted(node.operators() - supported):
        raise UnsupportedFilter(f"{backend} cannot evaluate {missing[0]!r}")


def path_of(field: str) -> str:
    """The variant path of a top-level field, whose name may hold dots and one kind of quotes."""
    quote = '"' if "'" in field else "'"
    if quote in field:
        raise UnsupportedFilter(f"a field name with both kinds of quotes: {field!r}")
    return f"$[{quote}{field}{quote}]"


def equal(v: Column, value: object) -> Column:
    """Whether a variant equals a JSON value."""
    kind = F.schema_of_variant(v)
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, (bool, int, float)):
        number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(numeric(kind), F.try_variant_get(v, "$", "double"))
        return number == float(value)
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
    return F.to_json(v) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def numeric(kind: Column) -> Column:
    return kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")


def ordered(op: str, v: Column, value: object) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(value, str):
        side, there = F.try_variant_get(v, "$", "string"), kind == "STRING"
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        side, there = F.try_variant_get(v, "$", "double"), numeric(kind)
    else:
        return F.lit(False)
    right = F.lit(value if isinstance(value, str) else float(value))
    return there & {"gt": side > right, "gte": side >= right, "lt": side < right, "lte": side <= right}[op]


def contains(v: Column, value: object) -> Column:
    kind = F.schema_of_variant(v)
    in_list = kind.startswith("ARRAY") & F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(equal(x, value), F.lit(False)))
    if isinstance(value, str):
        return F.when(kind == "STRING", F.contains(F.try_variant_get(v, "$", "string"), F.lit(value))).otherwise(in_list)
    return in_list


def compiled(node: Filter, metadata: Column, columns: dict[str, Column] | None = None) -> Column:
    """A boolean Column, never null. ``columns``: typed columns that stand for fields the variant lacks (document_id)."""
    if node.op == "and":
        return reduce(lambda a, b: a & b, (compiled(p, metadata, columns) for p in node.parts), F.lit(True))
    if node.op == "or":
        return reduce(lambda a, b: a | b, (compiled(p, metadata, columns) for p in node.parts), F.lit(False))
    if node.op == "not":
        return ~compiled(node.parts[0], metadata, columns)
    v = F.try_variant_get(metadata, path_of(node.field), "variant")
    if columns and node.field in columns:
        typed = F.parse_json(F.to_json(F.struct(columns[node.field].alias("x"))))
        v = F.coalesce(v, F.try_variant_get(typed, "$.x", "variant"))
    present, value = v.isNotNull(), node.value
    if node.op == "exists":
        out = present
    elif node.op == "eq":
        out = equal(v, value)
    elif node.op == "ne":
        out = present & ~F.coalesce(equal(v, value), F.lit(False))
    elif node.op in ("in", "nin"):
        listed = reduce(lambda a, b: a | b, (F.coalesce(equal(v, x), F.lit(False)) for x in value), F.lit(False)) if isinstance(value, (list, tuple)) else F.lit(False)
        out = present & (listed if node.op == "in" else ~listed)
    elif node.op == "contains":
        out = contains(v, value)
    elif node.op in ("gt", "gte", "lt", "lte"):
        out = ordered(node.op, v, value)
    else:
        raise UnsupportedFilter(f"unknown operator {node.op!r}")
    return F.coalesce(out, F.lit(False))


def shadow(field: str) -> str:
    """The column that holds a declared field beside the VARIANT."""
    return f"declared_{field}"


def shadowed(metadata: Column, field: str, kind: str) -> Column:
    """A declared field as a typed column: strings as they are, booleans and numbers as doubles; null where the field is of another type."""
    v = F.try_variant_get(metadata, path_of(field), "variant")
    of = F.schema_of_variant(v)
    if kind == "string":
        return F.when(of == "STRING", F.try_variant_get(v, "$", "string"))
    number = F.when(of == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(numeric(of), F.try_variant_get(v, "$", "double"))
    return number.cast("double")


def implied(node: Filter, columns: dict[str, tuple[Column, str]]) -> Column | None:
    """A condition on declared fields (name -> their column and its type) that holds for every row that ``node`` holds for, if there is one.

    It is there to be pushed into the scan, which cannot look into a VARIANT, and
    is put beside the compiled filter, never in its place.
    """
    if node.op == "and":
        known = [c for p in node.parts if (c := implied(p, columns)) is not None]
        return reduce(lambda a, b: a & b, known) if known else None
    if node.op == "or":
        known = [implied(p, columns) for p in node.parts]
        return reduce(lambda a, b: a | b, known) if known and all(c is not None for c in known) else None
    if node.op == "in" and isinstance(node.value, (list, tuple)):
        return implied(any_of(*[Filter("eq", node.field, x) for x in node.value]), columns) if node.value else None
    column = columns.get(node.field)
    if column is None or node.op not in ("eq", "gt", "gte", "lt", "lte"):
        return None
    kind, value = column[1], node.value
    if kind == "string" and not isinstance(value, str) or kind == "double" and (isinstance(value, str) or not isinstance(value, (bool, int, float))):
        return None
    side, right = column[0], F.lit(value if kind == "string" else float(value))
    return {"eq": side == right, "gt": side > right, "gte": side >= right, "lt": side < right, "lte": side <= right}[node.op]
