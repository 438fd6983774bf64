"""Counts and metrics.

COUNT, SUM, AVG, MIN and MAX over one field are an extension: one row each, in
double precision, over the documents that a where keeps (raw evaluator).
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.paths import Resolver
from ..functions.predicates import compile_where

METRICS = {"COUNT": None, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def metric_column(resolver: Resolver, metric: dict) -> Column:
    kind = str(metric.get("type", "")).upper()
    if kind not in METRICS:
        raise RequestError(f"Unknown metric: {metric.get('type')!r}")
    if kind == "COUNT":
        return F.count(F.lit(1))
    number = resolver.field(str(metric.get("field", ""))).number
    return METRICS[kind](number.cast("double") if number is not None else F.lit(None).cast("double"))


def metric(df: DataFrame, what: dict, where: Any = None) -> DataFrame:
    """One row, one column ``result``."""
    resolver = Resolver(df)
    if where is not None:
        df = df.where(compile_where(where, resolver, raw=True))
    return df.agg(metric_column(resolver, what).alias("result"))


def many_metrics(df: DataFrame, what: dict[str, tuple[dict, Any]]) -> DataFrame:
    """Several metrics, each with its own where, in one pass over the collection."""
    resolver = Resolver(df)
    columns = []
    for name, (m, where) in what.items():
        kind = str(m.get("type", "")).upper()
        column = F.lit(1) if kind == "COUNT" else resolver.field(m["field"]).number.cast("double")
        if where is not None:
            column = F.when(F.coalesce(compile_where(where, resolver, raw=True), F.lit(False)), column)
        columns.append((F.count if kind == "COUNT" else METRICS[kind])(column).alias(name))
    return df.agg(*columns)


def stats_one(df: DataFrame, collection: str, expires_at: int | None = None, max_size: int | None = None, expired: bool = False) -> DataFrame:
    """collection, count, and what the catalog knows of it; an expired collection counts zero."""
    n = F.count(F.lit(1)) if not expired else F.lit(0).cast("long")
    columns = [F.lit(collection).alias("collection"), n.alias("count")]
    if expires_at is not None:
        columns += [F.lit(expired).alias("expired"), F.lit(expires_at).alias("expiresAt")]
    if max_size is not None:
        columns.append(F.lit(max_size).alias("maxSize"))
    return df.agg(*columns) if not expired else df.sparkSession.range(1).select(*columns)


def stats_all(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, count) for each, and the total under a null name: counts are taken before the union."""
    counts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("collection"), "count") for name, df in sorted(collections.items())]
    every = reduce(DataFrame.unionByName, counts)
    return every.rollup("collection").agg(F.sum("count").alias("count"))
