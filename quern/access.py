"""Scopes that change what a request returns.

A scope is "action:collection:key"; "*" matches all, a trailing "*" a prefix.
A reader of some documents only gets those: by key, by key prefix, or both.
"""

from __future__ import annotations

from dataclasses import dataclass

from .errors import Forbidden


def matches(pattern: str, value: str) -> bool:
    return pattern == "*" or (pattern.endswith("*") and value.startswith(pattern[:-1])) or pattern == value


@dataclass(frozen=True)
class Scope:
    action: str
    collection: str
    key: str = "*"

    @classmethod
    def parse(cls, text: str) -> Scope:
        return cls(*(text.split(":", 2) + ["*", "*"])[:3])

    def covers(self, action: str, collection: str) -> bool:
        return matches(self.action, action) and matches(self.collection, collection)


def allowed(scopes: list[str], action: str, collection: str) -> tuple[bool, list[str], list[str]]:
    """(the whole collection?, concrete keys, key prefixes)."""
    mine = [s for s in map(Scope.parse, scopes) if s.covers(action, collection)]
    keys = sorted({s.key for s in mine if not s.key.endswith("*")})
    prefixes = sorted({s.key[:-1] for s in mine if s.key.endswith("*") and s.key != "*"})
    return any(s.key == "*" for s in mine), keys, prefixes


def restrict(body: dict, scopes: list[str]) -> dict:
    """A read request narrowed to what the scopes allow; a client's own _allowed_prefixes don't count."""
    body = {k: v for k, v in body.items() if k != "_allowed_prefixes"}
    whole, keys, prefixes = allowed(scopes, "read", body.get("collection", ""))
    if whole:
        return body
    if not keys and not prefixes:
        raise Forbidden()
    if "keys" in body:
        asked = [body["keys"]] if isinstance(body["keys"], str) else body["keys"]
        if any(k not in keys and not any(k.startswith(p) for p in prefixes) for k in asked):
            raise Forbidden()
        return body
    if prefixes:
        return body | {"_allowed_prefixes": [*prefixes, *keys]}
    return body | {"keys": keys}
