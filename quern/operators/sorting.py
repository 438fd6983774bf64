"""Sort orders with a tie break, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import Missing, Resolver, TypedField, VariantField
from ..plans.spec import QuerySpec, Route


def directed(keys: list[Column], descending: bool) -> list[Column]:
    """A missing value is last; a descending order is the whole order reversed, so there it is first."""
    return [k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys]


def ordered(df: DataFrame, spec: QuerySpec) -> DataFrame:
    if not spec.sort:
        return df.orderBy(F.col("_seq").asc() if spec.ascending else F.col("_seq").desc())
    resolver = Resolver(df)
    fields = [(resolver.field(s.path), s) for s in spec.sort]
    if spec.route is Route.SORT and len(fields) == 1:
        f, s = fields[0]
        if isinstance(f, Missing):
            return df.where(F.lit(False))
        if isinstance(f, VariantField):  # numbers only
            return df.where(f.number.isNotNull()).orderBy(f.number.desc() if s.descending else f.number.asc(), F.col("_key"))
        if isinstance(f, TypedField) and f.number is not None:
            return df.where(f.present).orderBy(f.number.desc() if s.descending else f.number.asc(), F.col("_key"))
    keys = [k for f, s in fields for k in directed(f.sort_keys(), s.descending)]
    return df.orderBy(*keys, F.col("_key" if spec.route is Route.SORT else "_seq"))


def page(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """Offset and limit after filter and sort; with a sort they plan to one top-k."""
    if spec.offset:
        df = df.offset(spec.offset)
    return df.limit(spec.count)
