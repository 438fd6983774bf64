"""SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z lower-cased; words ``[^\\x20\\x09-\\x0D]+``; word shingles,
repeats included, joined by spaces (fewer words: the whole sequence; none: zero);
a bit is set if it is set in over half of the shingles' XXH64 (seed 42).

Covering: bits 0-22 and 23-45 are each read in the binary Golay code, a perfect
code: every 23-bit string lies within 3 bits of exactly one codeword, its home.
An anchor is a pair of codewords.  If x and y differ in at most t bits, then y
lies within 3 + e1 and 3 + e2 bits of x's two home codewords, with e1 + e2 <= t.
So each distinct fingerprint goes once to its home anchor and is replicated to
every anchor within that covering radius plus threshold; per anchor, homes are
compared with replicas on all 64 bits.  Every link is found at the home of its
smaller end, exactly once.  The replicas of a fingerprint are a fixed number on
average (62 for t = 2), whatever the corpus.

Only distinct fingerprints are compared, so copies cost nothing more, and the
fingerprints near one anchor are bounded by the balls about it.  The links of a
partition are thinned to a spanning forest, and components come from
alternating large-star and small-star rounds; minima are aggregated before the
shuffle and joins are split by adaptive skew handling, so a large component
isn't gathered in a task.  Each round is cut off by a reliable checkpoint.

Null and empty texts have fingerprint zero and link like any other.  Repeated
rows are rows of one component; null ids stay in the result but are nobody's
component_id; texts of any length are read whole; ids are whole numbers; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import similar
from .common import checkpointed, partitions, remove, table, texts, words
from .components import components

#: Generator polynomial of the binary Golay code of length 23, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY, LENGTH, RADIUS = 0b110001110101, 23, 3
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = np.arange(8) * 256
PER_TASK = 50_000  # distinct fingerprints


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, unsigned."""
    found = words(text)
    if not found:
        return 0
    if len(found) <= width:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    total = len(found) - width + 1
    counts = np.zeros(2048, np.int64)
    for k in range(0, total, 100_000):
        upto = min(total, k + 100_000)
        hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts[k:upto], ends[k + width - 1 : upto + width - 1])), np.uint64, upto - k)
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs: (doc_id, text).  (doc_id, fp) with fp as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = np.array([fingerprint(t, width) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit strings modulo the generator polynomial."""
    x = x.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


@cache
def errors(t: int) -> list[list[np.ndarray]]:
    """[syndrome][e]: what to xor to a string of that syndrome to reach each codeword at distance 3 + e (e = 0: 3 or less, its home)."""
    patterns = np.zeros(1, np.int64)
    weight = np.zeros(1, np.int64)
    grown, top = patterns, np.full(1, -1)
    for w in range(1, RADIUS + t + 1):
        bits = np.arange(LENGTH)
        at = top[:, None] < bits
        nxt = (grown[:, None] | (1 << bits))[at]
        top = np.broadcast_to(bits, at.shape)[at]
        grown = nxt
        patterns, weight = np.concatenate([patterns, grown]), np.concatenate([weight, np.full(len(grown), w)])
    s, e = syndrome(patterns), np.maximum(0, weight - RADIUS)
    order = np.lexsort((e, s))
    patterns, s, e = patterns[order], s[order], e[order]
    bounds = np.searchsorted(s * (t + 1) + e, np.arange(2048 * (t + 1) + 1))
    return [[patterns[bounds[k * (t + 1) + j] : bounds[k * (t + 1) + j + 1]] for j in range(t + 1)] for k in range(2048)]


def anchors(fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint; the anchors that it is replicated to, and how many those are."""
    low = (1 << LENGTH) - 1
    a, b = fps & low, (fps >> LENGTH) & low
    table, out, sizes, home = errors(t), [], [], np.empty(len(fps), np.int64)
    for k, (x, y, sx, sy) in enumerate(zip(a.tolist(), b.tolist(), syndrome(a).tolist(), syndrome(b).tolist())):
        left, right = table[sx], table[sy]
        home[k] = ((x ^ int(left[0][0])) << LENGTH) | (y ^ int(right[0][0]))
        near = []
        for e in range(t + 1):
            other = np.concatenate(right[: t - e + 1])
            near.append((((x ^ left[e]) << LENGTH)[:, None] | (y ^ other)).ravel())
        near = np.concatenate(near)
        out.append(near)
        sizes.append(len(near))
    return home, np.concatenate(out) if out else np.zeros(0, np.int64), np.array(sizes, np.int64)


def links(distinct: DataFrame, t: int = 2) -> DataFrame:
    """distinct: (fp).  (a, b), a < b: the pairs of fingerprints that differ in 1 to t bits, each once.

    With a column root, a long, of distinct: (a, ra, b, rb), the pairs of different roots alone.
    """
    rooted = "root" in distinct.columns
    distinct = distinct.select("fp", *["root"] * rooted)
    schema = pa.schema([(x, pa.int64()) for x in ("anchor", *distinct.columns)])
    names = ", ".join(f"{x} long" for x in schema.names)

    def spread(homes: bool):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for k in range(0, batch.num_rows, 2000):
                    fps = batch.column(0).slice(k, 2000).to_numpy(zero_copy_only=False)
                    home, near, sizes = anchors(fps, t)
                    values = [fps, *(c.slice(k, 2000).to_numpy(zero_copy_only=False) for c in batch.columns[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([home, *values] if homes else [near, *(np.repeat(v, sizes) for v in values)])], schema=schema)

        return run

    # dealt out by number before replicas are made, and sized so that a task's homes fit in its hash table
    tasks = max(partitions(distinct.sparkSession), -(-distinct.count() // PER_TASK))
    dealt = distinct.repartition(tasks, "fp")
    home = dealt.mapInArrow(spread(True), names).withColumnsRenamed({"fp": "a", "root": "ra"}).repartition(tasks, "anchor")
    near = dealt.mapInArrow(spread(False), names).withColumnsRenamed({"fp": "b", "root": "rb"}).repartition(tasks, "anchor")
    met = near.join(home.hint("shuffle_hash"), "anchor").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= t)
    return met.where("ra != rb").select("a", "ra", "b", "rb") if rooted else met.select("a", "b")


def classes(prints: DataFrame, t: int = 2) -> DataFrame:
    """prints: (doc_id, fp).  (fp, root, component_id) for each distinct fingerprint; the root names the component."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = checkpointed(links(distinct, t))
    root = distinct.join(components(found), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = root.where("fp != root").groupBy("root").agg(F.min("least").alias("m"))
    top = root.where("fp = root").select("root", "least").join(joined, "root", "left").select("root", F.least("least", "m").alias("component_id"))
    return root.select("fp", "root").join(top, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, t: int = 2) -> DataFrame:
    """docs: (doc_id, text).  (doc_id, fp, component_id): the smallest doc_id that links reach."""
    prints = checkpointed(fingerprints(docs, width))
    return prints.join(classes(prints, t).drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, t: int = 2) -> DataFrame:
    """One row of each component of near copies, all columns as they are: the smallest doc_id (null last), then text hash.

    Near copies by weight are texts whose fingerprints of 5-word shingles are within t bits, as the anchors find them, and
    whose shingles with repeats have a similarity of 4/5 or more.  Near copies as sets are texts whose sets of shingles
    have one of 4/5 or more; their fingerprints differ in up to a dozen bits, which no anchors can cover at a bearable
    number of replicas, so a second covering, of the sets by their rare shingles (see ``similar``), finds them.  Both
    kinds of links count.
    """
    at, columns = docs.columns.index("text"), docs.columns
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            bodies = texts(batch.column(1))
            fps = np.array([fingerprint(x, similar.WIDTH) for x in bodies], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([similar.key(x) for x in bodies], pa.int64()), pa.array(fps)], schema=schema)

    def keyed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([similar.key(x) for x in texts(batch.column(at))], pa.int64())], names=[*columns, "_key"])

    prints = checkpointed(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, fp long"))
    each = checkpointed(prints.select("key", "fp").distinct())
    texts_ = docs.mapInArrow(keyed, StructType([*docs.schema.fields, StructField("_key", LongType())]))
    pairs, folder = similar.links(docs.select("text"), texts_.select(F.col("_key").alias("key"), "text"), each, lambda some: links(some, t))
    roots = components(pairs)
    remove(docs.sparkSession, folder)
    joined = prints.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("_id"), F.col("k.key").alias("_first"))
    kept = texts_.join(first, (F.col("_key") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = prints.groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "_key"]) if again else kept).select(*columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
