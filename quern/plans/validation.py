"""Names, sizes and allowed properties of requests."""

from __future__ import annotations

import json
import re
from typing import Any

from ..errors import RequestError

# Name patterns, reserved names, limits and each endpoint's properties.
COLLECTION = re.compile(r"[a-zA-Z0-9_-]{1,64}")
KEY = re.compile(r"[a-zA-Z0-9_.-]{1,256}")
FIELD = re.compile(r"[a-zA-Z0-9_.-]{1,128}")
RESERVED = {"admin", "system", "config", "internal", "__proto__"}
MAX_DEPTH, MAX_KEYS, MAX_COUNT, DEFAULT_COUNT, MAX_BYTES = 32, 1000, 1000, 100, 10 * 1024 * 1024
ALLOWED = {
    "get": {"collection", "keys", "where", "fields", "excludedFields", "joins", "sort", "order", "count", "offset", "_allowed_prefixes"},
    "set": {"collection", "data", "ttl", "maxSize"},
    "update": {"collection", "data"},
    "delete": {"collection", "keys", "where", "count", "order", "drop"},
    "schema": {"collection", "schema", "ttl", "maxSize"},
    "stats": {"collection"},
}


def collection_name(name: Any) -> str:
    if not isinstance(name, str) or not COLLECTION.fullmatch(name) or name in RESERVED:
        raise RequestError(f"Invalid collection name: {name!r}")
    return name


def key_name(key: Any) -> str:
    if not isinstance(key, str) or not KEY.fullmatch(key):
        raise RequestError(f"Invalid key: {key!r}")
    return key


def field_path(path: Any) -> str:
    if not isinstance(path, str) or not FIELD.fullmatch(path) or "" in path.split("."):
        raise RequestError(f"Invalid field name: {path!r}")
    return path


def depth(value: Any) -> int:
    """Nesting of a JSON value, found without recursion."""
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, d = todo.pop()
        deepest = max(deepest, d)
        todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return deepest


def request(endpoint: str, body: Any) -> dict:
    """The checks that every endpoint shares."""
    if not isinstance(body, dict):
        raise RequestError("The request must be an object")
    unknown = sorted(set(body) - ALLOWED[endpoint])
    if unknown:
        raise RequestError(f"Unknown property: {unknown[0]}")
    if depth(body) > MAX_DEPTH:
        raise RequestError("The request is nested too deeply")
    if len(json.dumps(body, ensure_ascii=False).encode()) > MAX_BYTES:
        raise RequestError("The request is too large", 413)
    for part in ("keys", "data"):
        value = body.get(part)
        if isinstance(value, (list, dict)) and len(value) > MAX_KEYS and not (part == "data" and isinstance(value, list)):
            raise RequestError(f"More than {MAX_KEYS} keys")
    if endpoint != "stats" or "collection" in body:
        collection_name(body.get("collection"))
    return body


def whole(value: Any, default: int | None) -> int | None:
    """A count or offset; what isn't a whole number of zero or more counts as not given."""
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default
