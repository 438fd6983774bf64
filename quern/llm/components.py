"""Connected components of links between 64-bit numbers, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

PER_TASK = 100_000  # links


def forest(pairs: DataFrame) -> DataFrame:
    """A spanning forest of each partition's (a, b) links; components stay the same."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in rows:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(root(x), x) for x in list(parent) if root(x) != x]
        for k in range(0, len(pairs), 50_000):
            some = pairs[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64())], schema=schema)

    return pairs.select("a", "b").mapInArrow(run, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) links but the roots themselves; root is the component's least node.

    The links of a round are written by as many tasks as they need, since each file of a checkpoint, an empty one too, costs
    the executor some processes.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # (u, v) as seen from u; least: the least of u and the neighbours considered
        if large:
            seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            seen = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = seen.join(least, "u")
        if large:
            out = joined.where("v > u and v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(forest(pairs).distinct())
    before = mark(edges)
    while before[0]:
        edges = checkpointed(star(star(edges, True), False).coalesce(-(-2 * before[0] // PER_TASK)))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
