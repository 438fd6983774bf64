"""Field inclusion and exclusion, and the shape of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import DOC, SYSTEM, json_path

OPT_IN = ("_seq", "_createdAt", "_modifiedAt", "_expiresAt")
KEY, VERSION = "_key", "_v"


def iso(ms: Column) -> Column:
    """Epoch milliseconds as YYYY-MM-DDTHH:MM:SSZ, cut to seconds."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def trie(paths: tuple[str, ...]) -> dict:
    """Paths as nested dicts; a path under a whole field adds nothing, a whole field takes over paths under it."""
    root: dict = {}
    for path in paths:
        node, parts = root, path.split(".")
        for k, part in enumerate(parts):
            if node.get(part, 0) is None:
                break
            if k == len(parts) - 1:
                node[part] = None
            else:
                node = node.setdefault(part, {})
    return root


def keep(column: Column, kind: T.DataType, wanted: dict | None) -> Column | None:
    """A struct rebuilt from the wanted paths; null if there is none of them."""
    if wanted is None:
        return column
    if isinstance(kind, T.VariantType):
        return keep_variant(column, wanted)
    if not isinstance(kind, T.StructType):
        return None
    parts = [(n, keep(column.getField(n), kind[n].dataType, sub)) for n, sub in wanted.items() if n in kind.names]
    parts = [(n, c) for n, c in parts if c is not None]
    return F.when(column.isNotNull(), F.struct(*[c.alias(n) for n, c in parts])) if parts else None


def keep_variant(doc: Column, wanted: dict, at: tuple[str, ...] = ()) -> Column:
    """A variant of the wanted paths; a missing path is left out, an explicit null stays."""

    def build(node: dict, prefix: tuple[str, ...]) -> Column:
        return F.struct(*[(F.try_variant_get(doc, json_path([*prefix, n]), "variant") if sub is None else some(sub, (*prefix, n))).alias(n) for n, sub in node.items()])

    def some(node: dict, prefix: tuple[str, ...]) -> Column:
        inner = build(node, prefix)
        present = [F.try_variant_get(doc, json_path([*prefix, *p]), "variant").isNotNull() for p in leaves(node)]
        any_ = present[0]
        for p in present[1:]:
            any_ = any_ | p
        return F.when(any_, inner)

    return F.parse_json(F.to_json(build(wanted, at)))


def leaves(node: dict) -> list[tuple[str, ...]]:
    return [(n, *rest) for n, sub in node.items() for rest in ([()] if sub is None else leaves(sub))]


def drop_paths(column: Column, kind: T.DataType, unwanted: dict) -> Column | None:
    """A struct or variant without the unwanted paths; None if nothing is left of it."""
    if isinstance(kind, T.VariantType):
        return drop_variant(column, unwanted)
    if not isinstance(kind, T.StructType):
        return column
    left = []
    for f in kind.fields:
        if f.name not in unwanted:
            left.append(column.getField(f.name).alias(f.name))
        elif unwanted[f.name] is not None:
            inner = drop_paths(column.getField(f.name), f.dataType, unwanted[f.name])
            if inner is not None:
                left.append(inner.alias(f.name))
    return F.when(column.isNotNull(), F.struct(*left)) if left else None


def within(name: str, sub: dict):
    """For transform_values: the member of that name, if it is an object, without the paths of sub."""

    def change(k: Column, x: Column) -> Column:
        is_object = F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
        return F.when((k == name) & is_object, drop_variant(x, sub)).otherwise(x)

    return change


def emptied(name: str):
    """For map_filter: not the member of that name if it is an object without members."""

    def test(k: Column, x: Column) -> Column:
        return ~((k == name) & (F.schema_of_variant(x) == "OBJECT<>"))

    return test


def drop_variant(value: Column, unwanted: dict) -> Column:
    members = F.try_variant_get(value, "$", "map<string,variant>")
    whole = [n for n, sub in unwanted.items() if sub is None]
    if whole:
        members = F.map_filter(members, lambda k, _: ~k.isin(whole))
    for name, sub in unwanted.items():
        if sub is not None:
            members = F.transform_values(members, within(name, sub))
            members = F.map_filter(members, emptied(name))
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    return F.when(is_object, F.parse_json(F.to_json(members))).otherwise(value)


def shape(df: DataFrame, fields: tuple[str, ...] | None, excluded: tuple[str, ...] | None, aliases: list[str], expires_at: int | None = None) -> DataFrame:
    """The result columns: key, version, the opted-in system fields, then the document's own and the joined ones."""
    own = [c for c in df.columns if c not in (KEY, *SYSTEM)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = [F.col(KEY), F.col(VERSION)]
    for name in fields or ():
        if name == "_seq":
            out.append(F.col("_seq"))
        elif name in ("_createdAt", "_modifiedAt") and name in kinds:
            out.append(iso(F.col(name)).alias(name))
        elif name == "_expiresAt" and expires_at is not None:
            out.append(iso(F.lit(expires_at)).alias(name))
    variant = isinstance(kinds.get(DOC), T.VariantType)
    if fields is not None:
        wanted = trie(tuple(f for f in fields if f not in (KEY, VERSION, *OPT_IN)))
        if variant:
            direct = {n: s for n, s in wanted.items() if n not in aliases}
            if direct:
                out.append(keep_variant(F.col(DOC), direct).alias(DOC))
        for n, sub in wanted.items():
            if n in own and (not variant or n in aliases):
                column = keep(F.col(f"`{n}`"), kinds[n], sub)
                if column is not None:
                    out.append(column.alias(n))
        out += [F.col(f"`{a}`") for a in aliases if a in own and a not in wanted]
    else:
        unwanted = trie(tuple(p for p in excluded or () if p not in (KEY, VERSION)))
        for n in own:
            if variant and n == DOC:
                out.append((drop_variant(F.col(DOC), unwanted) if unwanted else F.col(DOC)).alias(DOC))
            elif n in unwanted and n not in aliases:
                column = drop_paths(F.col(f"`{n}`"), kinds[n], unwanted[n]) if unwanted[n] is not None else None
                if column is not None:
                    out.append(column.alias(n))
            else:
                out.append(F.col(f"`{n}`"))
    return df.select(*out)
