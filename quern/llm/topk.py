"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, set where it is above zero (more
than 64 dimensions are first projected on 64 fixed random directions).  Equal
codes are one entry of the index with their k + 1 smallest ids, cut in each task
before the shuffle, so a hot code stays small; equal query codes are one search.

The entries are dealt out in blocks of at most about ``most`` entries, the queries
in parts, and a task holds the codes of one block and one part in arrays.  The
64 bits are cut into m segments of about log2(entries) - 4 bits, so that a
segment's value leads to some entries in a row; for each segment the block's codes
lie in order of its values, with the place where each value begins.  In round
s = 0, 1, 2, ... each open query probes, segment by segment, all values that
differ from its own in exactly s bits; full distances are verified, and the best
so far kept.  After segment j (from 0) of round s every code within distance
m s + j has been seen, as otherwise the segments up to j would differ in over s
bits each and the others in s at least.  So a query is done once its last wanted
distance is at most that: the result is exact.  When another round would make
more probes for a query than the block has entries, the queries still open read
the block's entries instead, which is exact too.  The first block's last wanted
distances bound the search in all others.

Neighbours are ordered by (distance, id); a vector isn't its own neighbour, but
copies under other ids are.  Fewer than k others give fewer rows.  Null, empty
and null-id vectors are neither indexed nor asked for; null elements and NaN
leave their bit unset; ids are whole numbers.  Rows repeated with their id are
one vector for each code; an empty table gives no rows; other columns are
ignored; vectors of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, table

PROJECT = "id long, code long"
MOST = 1 << 21  # entries in a block
AT_ONCE = 1 << 17  # candidates verified at a time
TASKS, FEWEST, QUERIES = 96, 200, 250_000  # tasks as far as each has FEWEST queries; the most queries of a task


def bits_of(column: pa.Array, seed: int, planes: dict[int, np.ndarray]) -> np.ndarray:
    """The codes of the vectors of a batch, taken by their lengths from the flat values."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = np.nan_to_num(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
    sizes, out = np.diff(offsets), np.zeros(len(column), np.uint64)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        x = values[offsets[at][:, None] + np.arange(n)]
        if n > 64:
            if n not in planes:
                planes[n] = np.random.default_rng(seed).standard_normal((64, n))
            x = x @ planes[n].T
        bits = np.zeros((len(at), 64), bool)
        bits[:, : x.shape[1]] = x > 0
        out[at] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def codes(vectors: DataFrame, seed: int = 11) -> DataFrame:
    """vectors: (id, vector).  (id, code), the code as a signed long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(bits_of(batch.column(1), seed, planes).view(np.int64))], names=["id", "code"])

    return vectors.select("id", "vector").where("id is not null and size(vector) > 0").mapInArrow(run, PROJECT)


def segments(entries: int, most: int = 8) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    m = min(most, max(1, round(64 / max(1.0, log2(max(entries, 2)) - 4))))
    cuts = [64 * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


@cache
def masks(width: int, s: int) -> np.ndarray:
    """The ways to differ in s bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), s)], np.int64)


def best_of(found: DataFrame, want: int) -> DataFrame:
    """found: (asked, distance, neighbor_id).  The first ``want`` of each search, cut in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "neighbor_id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= want).drop("_rank")


class Block:
    """The entries of a block: codes, and each one's ids, flat, ascending."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, most_segments: int = 8):
        self.codes, self.sizes, self.ids, self.starts = codes, sizes, ids, np.cumsum(sizes) - sizes
        self.first = ids[self.starts]
        self.cuts, self.index = segments(len(codes), most_segments), []
        for shift, width in self.cuts:
            value = self.values(codes, shift, width)
            order = np.argsort(value, kind="stable").astype(np.int32)
            begins = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))]).astype(np.int32)
            self.index.append((order, codes[order], begins))

    @staticmethod
    def values(codes: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def probe(self, asked: np.ndarray, limit: np.ndarray, s: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place among asked, distance, entry) of what segment j gives within the limits in round s, AT_ONCE candidates at a time, about."""
        (shift, width), (order, codes, begins) = self.cuts[j], self.index[j]
        mask, own = masks(width, s), self.values(asked, shift, width)
        step = max(1, AT_ONCE // max(1, len(mask)))
        for k in range(0, len(asked) if len(mask) else 0, step):
            value = (own[k : k + step, None] ^ mask).ravel()
            low = begins[value]
            n = begins[value + 1] - low
            met = np.flatnonzero(n)
            low, n, query = low[met], n[met].astype(np.int64), (k + met // len(mask)).astype(np.int32)
            upto = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
                some = n[at:to]
                places = np.repeat((low[at:to] - (np.cumsum(some) - some)).astype(np.int32), some) + np.arange(some.sum(), dtype=np.int32)
                who = np.repeat(query[at:to], some)
                d = np.bitwise_count(codes[places] ^ asked[who])
                near = np.flatnonzero(d <= limit[who])
                yield who[near], d[near].astype(np.int64), order[places[near]].astype(np.int64)
                at = to

    def best(self, who: np.ndarray, d: np.ndarray, entry: np.ndarray, limit: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``want`` entries of each query, each once; limits come down to the distance at which a query has ``want`` ids."""
        order = np.lexsort((self.first[entry], d, who))
        who, d, entry = who[order], d[order], entry[order]
        once = np.concatenate([[True], (who[1:] != who[:-1]) | (entry[1:] != entry[:-1])]) if len(who) else np.zeros(0, bool)  # an id is of one entry, as a rule
        who, d, entry = who[once], d[once], entry[once]
        begin = np.searchsorted(who, who)
        upto = np.cumsum(self.sizes[entry])
        have = upto - (upto - self.sizes[entry])[begin] if len(who) else upto
        full = np.flatnonzero(have >= want)
        np.minimum.at(limit, who[full], d[full])
        keep = (np.arange(len(who)) - begin < want) & (d <= limit[who])
        return who[keep], d[keep], entry[keep]

    def search(self, asked: np.ndarray, limit: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among asked, distance, id): the first ``want`` of each asked code within its limit."""
        none, limit = np.zeros(0, np.int64), limit.copy()
        found, open_, m, s = (none, none, none), np.arange(len(asked)), len(self.cuts), 0
        while len(open_) and s <= max(w for _, w in self.cuts) and sum(comb(w, s) for _, w in self.cuts) <= len(self.codes):
            for j in range(m):
                held, size = [found], 0
                for who, d, entry in self.probe(asked[open_], limit[open_].astype(np.uint8), s, j):
                    held.append((open_[who], d, entry))
                    size += len(who)
                    if size > AT_ONCE:
                        held, size = [self.best(*map(np.concatenate, zip(*held)), limit, want)], 0
                found = self.best(*map(np.concatenate, zip(*held)), limit, want) if size else held[0]
                open_ = open_[limit[open_] > m * s + j]
            s += 1
        if len(open_):
            rest = ~np.isin(found[0], open_)
            held = [tuple(x[rest] for x in found)]
            for q in open_.tolist():
                d = np.bitwise_count(self.codes ^ asked[q]).astype(np.int64)
                have = np.cumsum(np.bincount(d, weights=self.sizes, minlength=65))
                near = np.flatnonzero(d <= min(limit[q], int(np.searchsorted(have, want))))
                held.append(self.best(np.full(len(near), q), d[near], near, limit, want))
            found = tuple(map(np.concatenate, zip(*held)))
        who, d, entry = found
        n = self.sizes[entry]
        ids = self.ids[np.repeat(self.starts[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        who, d = np.repeat(who, n), np.repeat(d, n)
        order = np.lexsort((ids, d, who))
        order = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < want]
        return who[order], d[order], ids[order]


def meet(asked: DataFrame, entries: DataFrame, want: int, parts: int, block: int, most_segments: int) -> DataFrame:
    """asked: (asked, bound, block); entries: (code, ids, block).  (asked, distance, neighbor_id): the first ``want`` in each block within the bound."""
    out = pa.schema([("asked", pa.int64()), ("distance", pa.int32()), ("neighbor_id", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block and part; in each, entries first."""
        at, held, here = None, [], None

        def answer(codes: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(codes) if here else 0, block):
                some = codes[k : k + block]
                who, d, ids = here.search(some, bounds[k : k + block], want)
                yield pa.RecordBatch.from_arrays([pa.array(some[who].view(np.int64)), pa.array(d, pa.int32()), pa.array(ids, pa.int64())], schema=out)

        for batch in rows:
            cell, bound = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            cuts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]) | ((bound[1:] < 0) != (bound[:-1] < 0))) + 1, [len(cell)]]) if len(cell) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if cell[a] != at:
                    at, held, here = cell[a], [], None
                codes = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).view(np.uint64)
                if bound[a] < 0:
                    ids = batch.column(3).slice(a, b - a)
                    held.append((codes, np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False)))
                    continue
                if held:
                    here, held = Block(*map(np.concatenate, zip(*held)), most_segments), []
                yield from answer(codes, bound[a:b].astype(np.int64))

    cell = lambda part: (F.col("block") * parts + part).cast("long").alias("cell")
    each = entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(cell(F.col("part")), "code", F.lit(-1).alias("bound"), "ids")
    queries = asked.select(cell(F.pmod(F.xxhash64("asked"), F.lit(parts))), F.col("asked").alias("code"), F.col("bound").cast("int"), F.lit(None).cast("array<bigint>").alias("ids"))
    tasks = max(partitions(asked.sparkSession), parts * entries.select("block").distinct().count())  # by work, not by bytes
    return each.union(queries).repartition(tasks, "cell").sortWithinPartitions("cell", "bound").mapInArrow(run, "asked long, distance int, neighbor_id long")


def search(vectors: DataFrame, k: int = 10, every: int = 20, block: int = 1 << 12, most_segments: int = 8, most: int = MOST) -> DataFrame:
    """vectors: (id, vector).  (id, rank, neighbor_id, distance) for each id divisible by ``every``.  block: queries searched together; most: entries in a block."""
    coded = checkpointed(codes(vectors).distinct())
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = checkpointed(coded.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    own = coded.groupBy("id").count().agg(F.max("count")).first()[0] or 1  # how many codes an id has, one as a rule: so many places its own may take
    want = k + own
    blocks = max(1, -(-entries.count() // most))
    queries = coded.where(F.col("id") % every == 0)
    asked = checkpointed(queries.select(F.col("code").alias("asked")).distinct().withColumn("bound", F.lit(64)))
    n = asked.count()
    parts = max(1, min(-(-TASKS // blocks), -(-n // FEWEST)), -(-n // QUERIES))  # a block goes to so many tasks
    entries = entries.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int"))
    near = checkpointed(meet(asked.withColumn("block", F.lit(0)), entries.where("block = 0"), want, parts, block, most_segments))
    if blocks > 1:
        bound = near.groupBy("asked").agg(F.when(F.count("*") == want, F.max("distance")).otherwise(64).alias("bound"))
        others = asked.select("asked").join(bound, "asked", "left").select("asked", F.coalesce("bound", F.lit(64)).alias("bound"), F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("block"))
        near = best_of(near.union(meet(others, entries.where("block > 0"), want, parts, block, most_segments)), want)
    near = near.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))  # ``want`` at most
    each = queries.join(near, F.col("code") == F.col("asked"))
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("id")), 1, k)
    return each.select("id", F.posexplode(others).alias("rank", "n")).select("id", (F.col("rank") + 1).alias("rank"), F.col("n.neighbor_id").alias("neighbor_id"), F.col("n.distance").alias("distance"))


def op3_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(vectors).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
WITH coded AS (
    SELECT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code
    FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
ranked AS (
    SELECT q.vec_id, o.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, o.code)) AS INTEGER) AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, o.code)), o.vec_id) AS rank
    FROM coded q JOIN coded o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
