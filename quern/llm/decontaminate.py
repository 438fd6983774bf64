"""Benchmark decontamination by greedy string tiling.

Tokens are white-space words with A-Z lower-cased and ASCII punctuation taken
out, known by 63 bits of their XXH64.  A document is compared with a benchmark
item if they share a seed: a run of ``seed`` equal tokens (an item shorter than
that is a seed as a whole).  Documents and items meet in a join on the seeds'
hashes.  Before it, a Bloom filter of all seeds, of a size between two fixed
bounds, is broadcast, so that only documents with seeds that are likely the
benchmark's leave their partition, and each only with these; the join is exact.

For a pair that shares a seed, greedy string tiling covers the item with tiles:
search length by search length, from the longest down, Karp-Rabin hashes of the
item's unmarked runs are looked up in the document's unmarked runs; equal runs
are compared token by token and marked in both, the item's first with the
document's first that is still unmarked.  A tile never overlaps another, and
tiles may come in any order, so a reordered passage is covered like one in
order.  The pair is contaminated if the tiles, each of at least ``seed`` tokens,
cover at least ``threshold`` of the item's tokens.

Null and empty texts, and items without tokens, match nothing.  Texts of any
length are read whole.  Repeated rows give repeated rows; an item id that comes
twice is two items; null ids stay null (ids are whole numbers); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import checkpointed, keep_rows, mix, table, texts

_PUNCTUATION = string.punctuation.encode()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
LEAST_BITS, MOST_BITS, PROBES = 22, 27, 6  # the seeds' filter: powers of two of its bits
REMEMBERED = 300_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("item_tokens", pa.int64()), ("tiles", pa.int64()), ("coverage", pa.float64())])


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _PUNCTUATION).split()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(ids: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Karp-Rabin hashes modulo 2^64 of the runs of ``width`` ids, all of them or those that begin ``at``."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(ids) + 1)
    at = np.arange(n) if at is None else at
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * _SPREAD
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(31))) * up[:-1])])
        return (prefix[at + width] - prefix[at]) * down[at]


def free_runs(marked: bytearray, width: int) -> np.ndarray:
    """Starts of the unmarked runs of one length."""
    gone = np.concatenate([[0], np.cumsum(np.frombuffer(marked, np.uint8))])
    return np.flatnonzero(gone[width:] == gone[:-width]) if len(marked) >= width else np.zeros(0, np.int64)


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of each tile, longest first.

    doc holds -1 where a token is none of the item's; no tile crosses it.  If
    runs of a length are shared, runs of any smaller length are too, so the
    longest shared length is found by halving.
    """
    in_item, in_doc = bytearray(len(item)), bytearray((doc < 0).astype(np.uint8).tobytes())
    tiles: list[tuple[int, int, int]] = []

    def runs(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes in the item, and in the document those that the item has too."""
        i, d = free_runs(in_item, width), free_runs(in_doc, width)
        if not len(i) or not len(d):
            return i[:0], i[:0], d[:0], d[:0]
        hi, hd = rolling(item, width, i), rolling(doc, width, d)
        met = np.isin(hd, hi)
        return i, hi, d[met], hd[met]

    def mark(width: int) -> bool:
        i, hi, d, hd = runs(width)
        places: dict[int, list[int]] = {}
        for at, h in zip(d[::-1].tolist(), hd[::-1].tolist()):
            places.setdefault(h, []).append(at)  # the first place last, as places are taken off the end
        if places:
            for at, h in zip(i.tolist(), hi.tolist()):
                left = places.get(h)
                if not left or in_item.find(1, at, at + width) >= 0:
                    continue
                while left:  # a place that is marked, or taken, is never free again
                    other = left.pop()
                    if in_doc.find(1, other, other + width) < 0 and np.array_equal(item[at : at + width], doc[other : other + width]):
                        in_item[at : at + width] = in_doc[other : other + width] = b"\1" * width
                        tiles.append((at, other, width))
                        break
        return bool(places)

    width = len(item)
    while width >= least:
        if not mark(width):
            low, high = least - 1, width  # shared at low (or below the least), not at high
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if len(runs(middle)[2]) else (low, middle)
            if low < least:
                break
            width = low
            mark(width)
        width -= 1
    return tiles


class Tokens:
    """The numbers of a text's tokens; words are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        found, known = tokens(text), self.known
        values = list(map(known.get, found))
        if None in values:
            if len(known) > REMEMBERED:
                known.clear()
            for k, v in enumerate(values):
                if v is None:
                    values[k] = known[found[k]] = xxhash.xxh64_intdigest(found[k]) >> 1
        return np.array(values, np.int64)


def seeds_of(ids: np.ndarray, width: int) -> np.ndarray:
    """The hashes of the runs of ``width`` tokens."""
    return mix(rolling(ids, width), np.uint64(width)).view(np.int64)


class Seeds:
    """A Bloom filter of the benchmark's seeds and their widths."""

    def __init__(self, words: np.ndarray, widths: list[int]):
        self.words, self.widths = words, widths

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """The distinct seeds of a text that are likely the benchmark's."""
        out = []
        for width in self.widths:
            h = seeds_of(ids, width).view(np.uint64)
            for probe in range(PROBES):
                if not len(h):
                    break
                at = mix(h, np.uint64(probe)) & np.uint64(64 * len(self.words) - 1)
                h = h[(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
            out.append(h)
        return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def seed_table(benchmark: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, Seeds]:
    """benchmark: (item_id, text).  Items (item, item_id, tokens), their seeds (seed, item), and the seeds' filter."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in rows:
            ids = [known.of(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([min(seed, len(x)) for x in ids], pa.int32())], names=["item_id", "tokens", "width"])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for item, ids, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = np.unique(seeds_of(np.frombuffer(ids, np.int64), width))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), item))], names=["seed", "item"])

    def places(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([mix(h, np.uint64(p)) & np.uint64(size - 1) for p in range(PROBES)])) if len(h) else h
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    items = checkpointed(benchmark.select("item_id", "text").mapInArrow(read, "item_id long, tokens binary, width int").where("width > 0").withColumn("item", F.monotonically_increasing_id()))
    seeds = checkpointed(items.select("item", "tokens", "width").mapInArrow(cut, "seed long, item long"))
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (24 * seeds.count()).bit_length()))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most ``seed``
    held = seeds.select("seed").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^MOST_BITS bits
    words = np.zeros(size >> 6, np.uint64)
    words[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return items.select("item", "item_id", "tokens"), seeds, Seeds(words, widths)


def near(ids: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """The document's runs of ``least`` or more of the item's tokens, parted by -1."""
    mine = np.isin(ids, item)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
    parts = [np.append(ids[a:b], -1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def candidates(docs: DataFrame, filtered: Callable[[], Seeds]) -> DataFrame:
    """(row, doc, tokens, seeds) of the rows with a likely seed, doc holding all columns."""
    at = docs.columns.index("text")
    schema = StructType([StructField("doc", docs.schema), StructField("tokens", BinaryType()), StructField("seeds", ArrayType(LongType()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seeds = Tokens(), filtered()
        for batch in rows:
            some, ids, hits = [], [], []
            for n, text in enumerate(texts(batch.column(at))):
                x = known.of(text)
                found = seeds.hits(x)
                if len(found):
                    some.append(n)
                    ids.append(x.tobytes())
                    hits.append(found)
            if some:
                part = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(part.columns, fields=list(part.schema)), pa.array(ids, pa.binary()), pa.array(hits, pa.list_(pa.int64()))], names=["doc", "tokens", "seeds"])

    return checkpointed(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def verified(found: DataFrame, items: DataFrame, seeds: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(row, item_id, matched, item_tokens, tiles, coverage) of the contaminated pairs."""
    kind = "row long, item_id long, matched long, item_tokens long, tiles long, coverage double"
    schema = pa.schema([("row", pa.int64()), *list(SCHEMA)[1:]])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for row, item_id, a, b in zip(*(batch.column(n) for n in range(4))):
                item, doc = (np.frombuffer(x.as_buffer(), np.int64) for x in (a, b))
                least = min(seed, len(item))
                tiles = tile(item, near(doc, item, least), least)
                matched = sum(n for _, _, n in tiles)
                if matched >= threshold * len(item):
                    out.append((row.as_py(), item_id.as_py(), matched, len(item), len(tiles), matched / len(item)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    pairs = found.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item").distinct()
    both = pairs.join(items.withColumnRenamed("tokens", "own"), "item").join(found.select("row", "tokens"), "row")
    return both.select("row", "item_id", "own", "tokens").mapInArrow(run, kind)


def filter_of(spark: SparkSession, seeds: Seeds) -> Callable[[], Seeds]:
    shared = spark.sparkContext.broadcast(seeds)  # at most 2^MOST_BITS bits
    return lambda: shared.value


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = 5) -> DataFrame:
    """docs: (doc_id, text); benchmark: (item_id, text).  One row for each contaminated pair."""
    items, seeds, bloom = seed_table(benchmark, seed)
    found = candidates(docs.select("doc_id", "text"), filter_of(docs.sparkSession, bloom))
    pairs = verified(found, items, seeds, threshold, seed)
    return pairs.join(found.select("row", F.col("doc.doc_id").cast("long").alias("doc_id")), "row").select("doc_id", "item_id", "matched", "item_tokens", "tiles", "coverage")


def keep(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = 5) -> DataFrame:
    """The rows that cover no item enough, all columns as they are; rows without a likely seed aren't shuffled."""
    items, seeds, bloom = seed_table(benchmark, seed)
    filtered = filter_of(docs.sparkSession, bloom)

    def judge():
        known, seeds = Tokens(), filtered()
        return lambda bodies: np.array([not len(seeds.hits(known.of(t))) for t in bodies], bool)

    found = candidates(docs, filtered)
    bad = verified(found, items, seeds, threshold, seed).select("row").distinct()
    return keep_rows(docs, judge).unionByName(found.join(bad, "row", "left_anti").select("doc.*"))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
