"""where clauses as Columns, by either of two evaluators.

``raw`` answers false for what it can't compare, and for a missing field;
``value`` takes a missing field for null.  Route decides which one applies (see
``plans.spec.Route``); a scan needs both.  An unknown operator or a malformed
clause is an error when the plan is built, for either.

Leaves spell out what null does to them, so a filter needs no coalesce and its
conjuncts still reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..plans.validation import field_path
from .paths import SYSTEM, Field, Missing, Resolver, VariantField, same

# Operator names and their aliases.
OPERATORS = {
    "$eq": "eq", "$equals": "eq", "$ne": "ne", "$notEquals": "ne",
    "$gt": "gt", "$greaterThan": "gt", "$gte": "gte", "$greaterThanOrEqual": "gte",
    "$lt": "lt", "$lessThan": "lt", "$lte": "lte", "$lessThanOrEqual": "lte",
    "$in": "in", "$oneOf": "in", "$nin": "nin", "$notIn": "nin", "$contains": "contains", "$ct": "contains",
}
COMPARE: dict[str, Callable[[Column, Column], Column]] = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def missing_or_null(f: Field) -> Column:
    return (~f.present) | f.null if isinstance(f, VariantField) else ~f.present


def one_of(f: Field, values: list, null_too: bool) -> Column:
    """Membership; strings of one list and whole numbers are one IN each."""
    parts = []
    strings = [x.lower() for x in values if isinstance(x, str)]
    if strings and f.string is not None:
        parts.append(F.lower(f.string).isin(strings))
    numbers = [x for x in values if is_number(x)]
    if numbers and f.number is not None:
        exact = [x for x in numbers if f.whole_number or abs(x) > 1]
        if exact:
            parts.append(f.number.isin(exact))
        parts += [same(f, x) for x in numbers if x not in exact]
    parts += [same(f, x) for x in values if isinstance(x, (bool, list, dict))]
    if null_too and None in values:
        parts.append(missing_or_null(f))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def not_(c: Column) -> Column:
    """True where c is false or unknown."""
    return ~F.coalesce(c, F.lit(False))


def raw_leaf(f: Field, op: str, value: Any) -> Column:
    if op in ("eq", "ne"):
        if not isinstance(value, (str, bool, int, float)):
            return F.lit(False)
        if op == "eq":
            return same(f, value)
        of_type = f.boolean if isinstance(value, bool) else f.number if is_number(value) else f.string
        return F.lit(False) if of_type is None else of_type.isNotNull() & ~same(f, value)
    if op in COMPARE:
        return COMPARE[op](f.number, F.lit(value)) if is_number(value) and f.number is not None else F.lit(False)
    if op == "in":
        return one_of(f, value, False) if isinstance(value, list) else F.lit(False)
    if op == "nin":
        return f.present & not_(one_of(f, value, False)) if isinstance(value, list) else F.lit(False)
    return contains(f, value, f.element_like(value)) if isinstance(value, str) else F.lit(False)


def value_leaf(f: Field, op: str, value: Any) -> Column:
    if op in ("eq", "ne"):
        equal = missing_or_null(f) if value is None else same(f, value)
        return equal if op == "eq" else ~f.present | not_(equal) if value is not None else ~equal
    if op in COMPARE:
        return raw_leaf(f, op, value)
    if op in ("in", "nin"):
        if not isinstance(value, list):
            raise RequestError(f"${op} needs an array")
        inside = one_of(f, value, True)
        return inside if op == "in" else not_(inside)
    return contains(f, value, f.element_is(value))


def contains(f: Field, needle: Any, element: Column | None) -> Column:
    parts = [element] if element is not None else []
    if f.string is not None and isinstance(needle, str):
        parts.append(F.contains(F.lower(f.string), F.lit(needle.lower())))
    return reduce(lambda a, b: F.coalesce(a, F.lit(False)) | b, parts) if parts else F.lit(False)


def system_leaf(f: Field, op: str, value: Any) -> Column:
    """The six comparisons of unsigned counters; a fraction is cut off and a negative number counts as zero."""
    if not is_number(value) or op not in ("eq", "ne", *COMPARE):
        return F.lit(False)
    n = F.lit(max(int(value), 0))
    return f.number == n if op == "eq" else f.number != n if op == "ne" else COMPARE[op](f.number, n)


def compile_where(where: Any, resolver: Resolver, raw: bool) -> Column:
    """The whole clause: an object's members and an array's elements all have to hold; a Column is taken as it is."""
    if isinstance(where, Column):
        return where
    if isinstance(where, list):
        return every([compile_where(x, resolver, raw) for x in where])
    if not isinstance(where, dict):
        raise RequestError("where must be an object or an array of objects")
    parts = []
    for name, clause in where.items():
        if name in ("$or", "$and"):
            if not isinstance(clause, list):
                raise RequestError(f"{name} needs an array")
            inner = [compile_where(x, resolver, raw) for x in clause]
            parts.append(every(inner) if name == "$and" else reduce(lambda a, b: a | b, inner) if inner else F.lit(False))
        elif name.startswith("$"):
            raise RequestError(f"Unknown operator: {name}")
        else:
            parts.append(field_clause(field_path(name), clause, resolver, raw))
    return every(parts)


def every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def field_clause(path: str, clause: Any, resolver: Resolver, raw: bool) -> Column:
    field = resolver.field(path)
    leaf = raw_leaf if raw else value_leaf
    if raw and path in SYSTEM and not isinstance(field, Missing):
        leaf = system_leaf
    if isinstance(clause, dict) and any(k.startswith("$") for k in clause):
        for k in clause:
            if k not in OPERATORS:
                raise RequestError(f"Unknown operator: {k}")
        return every([leaf(field, OPERATORS[k], v) for k, v in clause.items()])
    if not raw and clause is None:
        return field.null if isinstance(field, VariantField) else F.lit(False)
    return leaf(field, "eq", clause)


def where_column(where: Any, resolver: Resolver, raw: bool, value: bool) -> Column:
    parts = [compile_where(where, resolver, r) for r, on in ((True, raw), (False, value)) if on]
    return every(parts)
