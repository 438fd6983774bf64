"""A read spec as one lazy DataFrame: scan, keys and prefixes, joins, where, sort, page, shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import Resolver
from ..errors import RequestError
from ..functions.predicates import where_column
from ..operators.joins import lookups
from ..operators.projection import shape
from ..operators.sorting import ordered, page
from ..sources.catalog import Catalog
from . import spec as s

#: Which evaluators decide a where: (raw, value).
EVALUATORS = {s.Route.SORT: (True, False), s.Route.SCAN: (True, True), s.Route.KEYS: (False, True), s.Route.JOINS: (False, True), s.Route.DELETE: (True, False)}


def selected(df: DataFrame, spec: s.QuerySpec, catalog: Catalog) -> DataFrame:
    """Keys, prefixes, joins and where, without order."""
    if spec.keys is not None:
        df = catalog[spec.collection].with_keys(df, spec.keys)
    if spec.prefixes is not None:
        df = df.where(reduce(lambda a, b: a | b, [F.startswith(F.col("_key"), F.lit(p)) for p in spec.prefixes], F.lit(False)))
    df = lookups(df, spec.joins, lambda name: catalog[name].documents())
    if spec.where is not None:
        raw, value = EVALUATORS[spec.route]
        df = df.where(where_column(spec.where, Resolver(df), raw, value))
    return df


def plan(spec: s.QuerySpec, catalog: Catalog, now_ms: int | None = None) -> DataFrame:
    collection = catalog[spec.collection]
    df = collection.documents()
    if collection.expired(now_ms):
        df = df.where(F.lit(False))
    df = selected(df, spec, catalog)
    if not spec.single:
        df = page(ordered(df, spec), spec)
    out = shape(df, spec.fields, spec.excluded, [j.alias for j in spec.joins], collection.expires_at)
    return out.drop("_key") if spec.single else out


def query(catalog: Catalog, body: dict, now_ms: int | None = None) -> DataFrame:
    """A request, validated and planned."""
    return plan(s.read(body), catalog, now_ms)


def together(specs: list[s.QuerySpec], catalog: Catalog, now_ms: int | None = None) -> DataFrame:
    """Scans of one collection (where, order, offset and count alone) that share one reading of it.

    Each row is tagged with the requests that it answers; a request's page is cut in
    each task before the shuffle.  (request, place, columns of the collection); place is the row's in its request.
    """
    if not specs or len({x.collection for x in specs}) != 1 or any(x.keys is not None or x.joins or x.sort or x.prefixes is not None or x.fields is not None or x.excluded is not None for x in specs):
        raise RequestError("Only scans of one collection go together")
    collection = catalog[specs[0].collection]
    df = collection.documents()
    if collection.expired(now_ms):
        df = df.where(F.lit(False))
    resolver, n = Resolver(df), len(specs)
    hits = [F.when(F.lit(True) if x.where is None else where_column(x.where, resolver, *EVALUATORS[s.Route.SCAN]), F.lit(k)) for k, x in enumerate(specs)]
    tagged = df.withColumn("request", F.explode(F.array_compact(F.array(*hits))))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("request") + 1)
    order = F.when(pick([x.ascending for x in specs]), F.col("_seq")).otherwise(-F.col("_seq"))
    ranked = tagged.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(order)))
    most = max(x.offset + x.count for x in specs)  # a bound that every task can cut by
    ranked = ranked.where(F.col("place") <= most).where((F.col("place") > pick([x.offset for x in specs])) & (F.col("place") <= pick([x.offset + x.count for x in specs])))
    return ranked.withColumn("place", F.col("place") - pick([x.offset for x in specs])).select("request", "place", *df.columns)
