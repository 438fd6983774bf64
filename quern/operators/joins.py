"""Left outer lookup joins: embed the document that a string field names.

No side is forced to be broadcast: Catalyst broadcasts the looked-up side where
its size is known to be small, and otherwise sorts and merges, with skewed keys
split at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import DOC, Resolver
from ..plans.spec import JoinSpec
from .projection import keep, keep_variant, trie


def embedded(right: DataFrame, fields: tuple[str, ...] | None):
    """The looked-up document as one column: whole, with its version, sequence and times, or of some fields."""
    kinds = {f.name: f.dataType for f in right.schema.fields}
    variant = isinstance(kinds.get(DOC), T.VariantType)
    if fields is None:
        names = [c for c in right.columns if c != "_key"]
        return F.struct(*[F.col(f"`{c}`") for c in names]) if not variant else F.col(DOC)
    wanted = trie(fields)
    if variant:
        return keep_variant(F.col(DOC), wanted) if wanted else F.parse_json(F.lit("{}"))
    parts = [(n, keep(F.col(f"`{n}`"), kinds[n], sub)) for n, sub in wanted.items() if n in kinds]
    return F.struct(*[c.alias(n) for n, c in parts if c is not None]) if any(c is not None for _, c in parts) else F.struct(F.lit(None).cast("string").alias("_none"))


def lookup(df: DataFrame, join: JoinSpec, source: Callable[[str], DataFrame]) -> DataFrame:
    """Adds the alias, null where nothing is found; a field of that name is overwritten."""
    right = source(join.source)
    value = embedded(right, join.fields).alias("__value")
    key = Resolver(df).field(join.on).string
    if key is None:  # only a string names a document
        empty = right.select(value).schema["__value"].dataType
        return df.drop(join.alias).withColumn(join.alias, F.lit(None).cast(empty))
    right = right.select(F.col("_key").alias("__key"), value)
    return df.withColumn("__on", key).join(right, F.col("__on") == F.col("__key"), "left").drop("__on", "__key", join.alias).withColumnRenamed("__value", join.alias)


def lookups(df: DataFrame, joins: tuple[JoinSpec, ...], source: Callable[[str], DataFrame]) -> DataFrame:
    """In their order: a later join may look through an earlier alias."""
    for join in joins:
        df = lookup(df, join, source)
    return df


def listed(df: DataFrame, keys: DataFrame, key: str = "_key") -> DataFrame:
    """The documents whose key is in another collection's stored list."""
    return df.join(keys.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")

