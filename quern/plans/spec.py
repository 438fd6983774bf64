"""The only intermediate form: a validated read request."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from ..errors import RequestError
from . import validation as v


class Route(Enum):
    """Which evaluator decides a where, and how ties sort; one table of request shapes."""

    SORT = "sort"  # sort alone: raw evaluator; ties by key
    SCAN = "scan"  # where without sort, joins and keys, or with a prefix: raw and value evaluators
    KEYS = "keys"  # keys: value evaluator
    JOINS = "joins"  # joins: value evaluator, after the joins
    DELETE = "delete"  # raw evaluator


@dataclass(frozen=True)
class SortSpec:
    path: str
    descending: bool = False


@dataclass(frozen=True)
class JoinSpec:
    alias: str
    source: str
    on: str
    fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class QuerySpec:
    collection: str
    keys: tuple[str, ...] | None = None
    single: bool = False
    where: Any = None
    fields: tuple[str, ...] | None = None
    excluded: tuple[str, ...] | None = None
    joins: tuple[JoinSpec, ...] = ()
    sort: tuple[SortSpec, ...] = ()
    ascending: bool = False
    count: int = v.DEFAULT_COUNT
    offset: int = 0
    prefixes: tuple[str, ...] | None = None
    route: Route = field(default=Route.SCAN)


def sort_specs(value: Any) -> tuple[SortSpec, ...]:
    """"f" or {field, order}; a bad spec is skipped, an unknown order is ascending."""
    out = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, str) and item:
            out.append(SortSpec(item))
        elif isinstance(item, dict) and isinstance(item.get("field"), str) and item["field"]:
            out.append(SortSpec(item["field"], str(item.get("order", "")).lower() == "desc"))
    return tuple(out)


def join_specs(value: Any) -> tuple[JoinSpec, ...]:
    """One join for each element of the list; of an element's members the first object that holds "from" counts."""
    if value is None:
        return ()
    if not isinstance(value, list):
        raise RequestError("joins must be an array")
    out = []
    for element in value:
        if not isinstance(element, dict):
            raise RequestError("Each join must be an object")
        hit = next(((a, j) for a, j in element.items() if isinstance(j, dict) and "from" in j), None)
        if hit is None or not isinstance(hit[1].get("on"), str):
            continue
        alias, join = hit
        fields = join.get("fields")
        out.append(JoinSpec(v.field_path(alias), v.collection_name(join["from"]), join["on"], tuple(fields) if isinstance(fields, list) else None))
    return tuple(out)


def names(value: Any, what: str) -> tuple[str, ...] | None:
    if value is None:
        return None
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise RequestError(f"{what} must be an array of field names")
    return tuple(value)


def read(body: Any) -> QuerySpec:
    """A read request as a spec."""
    b = v.request("get", body)
    fields, excluded = names(b.get("fields"), "fields"), names(b.get("excludedFields"), "excludedFields")
    if fields is not None and excluded is not None:
        raise RequestError("fields and excludedFields exclude each other")
    for f in fields or ():
        v.field_path(f)
    order, sort = b.get("order"), sort_specs(b["sort"]) if "sort" in b else ()
    if order is not None and "sort" in b:
        raise RequestError("order and sort exclude each other")
    if order not in (None, "asc", "desc"):
        raise RequestError('order must be "asc" or "desc"')
    count = v.whole(b.get("count"), v.DEFAULT_COUNT)
    if count > v.MAX_COUNT:
        raise RequestError(f"count must be at most {v.MAX_COUNT}")
    keys = b.get("keys")
    single = isinstance(keys, str)
    if keys is not None:
        keys = tuple(dict.fromkeys(v.key_name(k) for k in ([keys] if single else keys if isinstance(keys, list) else [None])))
    if isinstance(b.get("where"), dict):
        for f in b["where"]:
            if not f.startswith("$"):
                v.field_path(f)
    joins, prefixes = join_specs(b.get("joins")), names(b.get("_allowed_prefixes"), "_allowed_prefixes")
    route = Route.KEYS if keys is not None else Route.JOINS if joins else Route.SORT if sort and prefixes is None else Route.SCAN
    return QuerySpec(b["collection"], keys, single, b.get("where"), fields, excluded, joins, sort, order == "asc", count, v.whole(b.get("offset"), 0), prefixes, route)
