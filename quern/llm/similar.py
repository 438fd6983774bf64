"""The links of ``simhash.keep_one``: near copies by SimHash and by the similarity of their word shingles, exactly.

Two texts are linked

    by weight   if their fingerprints link and the similarity of their WIDTH-word
                shingles with repeats (sum of least counts over sum of greatest)
                is 4/5 or more, as fingerprints count repeats, or
    as sets     if the Jaccard similarity of their sets of shingles is 4/5 or more

(a text of fewer words is one shingle).  Texts of the same words (A-Z lower-cased)
are one text.  Neither kind holds the other: texts of one line, again and again,
and some words of their own are linked by weight alone.  No link is missed but by
a collision of 64-bit hashes (XXH64).

Candidates by weight: the texts of linked fingerprints.  The least text of each
fingerprint is compared first, along a spanning forest of the links; at the end,
all that are still apart.

Candidates as sets: put each set in one order.  Of sets with n and m shingles that are
linked, each has the first shared one among its first n - ceil(4n/5) + 1, and
from there on both are long enough for the overlap (prefix and position
filters).  Any order common to all sets is exact.  It goes by the number of texts
that hold a shingle, from few to many, as a log-frequency Bloom filter gives it
(see ``lm``), so a text with a fifth of its own, whatever lines and passages it
shares with others, is nobody's candidate.  All shingles are counted, in 40 bits of
their hashes, sorted, packed and dealt out in shards; those of two texts or more enter
the filter.  One of more than FILTER_MB would hold those of 4, 8, ... texts or more;
shingles outside it then come first and stay candidates.

Links: the candidates that the fingerprints gave are verified first, in both
ways.  Where components remain apart, each text is compared with the least and the greatest text of each
of its prefix shingles.  While those of different components would still make more
than PAIRS pairs for each posting, and links are found, the texts of each shingle are dealt by a hash, anew each time and
ROUNDS times at most, into heaps of about HEAP and compared within them, so a large group of copies costs little more than its size.
Then only texts of still different components that share a prefix shingle are
compared, all of them.  Candidates are verified in two steps: the number of
shingles in each of SKETCH ranges of hashes bounds the overlap from above and
sends most of the others away; the rest are verified on the whole sets, and only
sets that such a pair needs travel.  Sets are made of texts with a candidate alone: up to ASKED
keys of them are broadcast, more are joined.

Null and empty texts are one text without shingles.  Repeated rows are copies;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix, partitions, shared_dir, texts, words
from .components import components, forest
from .lm import BITS, LogBloom, levels, merged

WIDTH = 5
SKETCH = 256  # ranges of hashes, a power of two
SHARD, FLUSH = 32 << 20, 3_000_000  # bytes of text for each shard of the counts; shingles that a task counts at a time
FILTER_MB, LEAST = 64, 12  # the least numbers of texts tried are 2, 4, ... up to 2^LEAST
ASKED = 4_000_000
HEAP, ROUNDS, PAIRS = 64, 3, 2
DROPPED = np.uint64(24)  # bits of a hash that counting leaves out


def key(text: bytes) -> int:
    """The hash of the sequence of words, signed."""
    return xxhash.xxh64_intdigest(b" ".join(words(text)), 7) - (1 << 63)


def hashes(text: bytes) -> np.ndarray:
    """The hashes of the text's shingles, repeats included, in their order."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    total = max(1, len(found) - WIDTH + 1)
    each = (digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[min(WIDTH, len(found)) - 1 :]))
    return np.fromiter(each, np.uint64, total)


def shingles(text: bytes) -> np.ndarray:
    """The hashes of the text's shingles, signed, sorted, each once."""
    return np.unique(hashes(text).view(np.int64))


def repeats(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """shingles(text), and a hash of shingle and number for each time that one comes again, signed, sorted."""
    grams, counts = np.unique(hashes(text).view(np.int64), return_counts=True)
    more = counts - 1
    number = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return grams, np.sort(mix(np.repeat(grams, more).view(np.uint64), number.astype(np.uint64)).view(np.int64))


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def sets(docs: DataFrame, keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """docs: (text); keyed: the same with key.  (key, grams, again, sketch) of the asked keys, once for each key of a task.

    again: see repeats; sketch: the number of grams in each range.
    """
    schema = pa.schema([("key", pa.int64()), ("grams", pa.list_(pa.int64())), ("again", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int32()))])
    few = asked.count() <= ASKED
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(asked.toArrow().column(0).to_numpy()) if few else None)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wanted_ = set(), wanted.value
        for batch in rows:
            for k in range(0, batch.num_rows, 500):
                bodies = texts(batch.column(0).slice(k, 500))
                keys = [key(t) for t in bodies]
                if few:
                    own = np.array(keys, np.int64)
                    inside = np.searchsorted(wanted_, own, "right") > np.searchsorted(wanted_, own)
                else:
                    inside = np.ones(len(keys), bool)
                some = [(keys[j], bodies[j]) for j in np.flatnonzero(inside).tolist() if keys[j] not in seen and not seen.add(keys[j])]
                grams, again = zip(*(repeats(t) for _, t in some)) if some else ((), ())
                sketches = [np.bincount(g.view(np.uint64) // np.uint64(2**64 // SKETCH), minlength=SKETCH).astype(np.int32) for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([i for i, _ in some], grams, again, sketches), schema)], schema=schema)

    found = docs if few else keyed.join(asked, "key", "left_semi")
    return found.select("text").mapInArrow(run, "key long, grams array<long>, again array<long>, sketch array<int>")


def planes(values: np.ndarray) -> bytes:
    """Whole numbers packed as their first bytes, then their second ones, and so on."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def frequent(docs: DataFrame) -> tuple[LogBloom, bool]:
    """docs: (text).  The filter of the shingles, without DROPPED bits, that several texts hold, and whether it has all that two do."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    shard_bits = (max(15, 2 * partitions(spark) - 1, size // SHARD)).bit_length()
    blobs = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    kept = pa.schema([*blobs, ("entries", pa.list_(pa.int64()))])

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            own = keys >> np.uint64(40 - shard_bits)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            cuts = list(zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist()))
            steps = [planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts]
            return pa.RecordBatch.from_arrays([pa.array(own[starts].astype(np.int32)), pa.array(steps, pa.binary()), pa.array([planes(counts[a:b]) for a, b in cuts], pa.binary())], schema=blobs)

        for batch in rows:
            for k in range(0, batch.num_rows, 500):
                for text in texts(batch.column(0).slice(k, 500)):
                    if (i := key(text)) not in seen:
                        seen.add(i)
                        held.append(shingles(text).view(np.uint64) >> DROPPED)
                        size += len(held[-1])
                        if size >= FLUSH:
                            yield flush()
                            held, size = [], 0
        if size:
            yield flush()

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, so that one shard is held at a time."""
        at, held = None, []

        def finish() -> pa.RecordBatch:
            keys, counts = merged(*zip(*held))
            keys, counts = keys[counts > 1], counts[counts > 1]
            entries = [int(levels(2, counts[counts >= n] - n + 1.0).sum()) for n in (2 << j for j in range(LEAST))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((at, (keys << DROPPED).tobytes(), counts.tobytes(), entries), kept)], schema=kept)

        for batch in rows:
            for shard, keys, counts in zip(*(column.to_pylist() for column in batch.columns)):
                if shard != at:
                    if held:
                        yield finish()
                    at, held = shard, []
                held.append((np.cumsum(unplaned(keys), dtype=np.uint64), unplaned(counts).astype(np.int64)))
                if sum(len(x) for x, _ in held[1:]) > max(FLUSH, len(held[0][0])):
                    held = [merged(*zip(*held))]
        if held:
            yield finish()

    names = "shard int, keys binary, counts binary"
    counted = docs.select("text").mapInArrow(gather, names).repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, f"{names}, entries array<long>")
    counted = checkpointed(counted)
    entries = counted.select(*(F.sum(F.get("entries", F.lit(j))) for j in range(LEAST))).first()
    j = next((j for j in range(LEAST) if BITS * (entries[j] or 0) <= FILTER_MB << 23), LEAST)
    least, parts = 2 << j, pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("bits", pa.binary())])

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shard, keys, counts in zip(*(column.to_pylist() for column in batch.columns)):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                if j < LEAST and (counts >= least).any():
                    size, bits = LogBloom.build(2, keys[counts >= least], counts[counts >= least] - least + 1.0)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, size, bits), parts)], schema=parts)

    rows = counted.select("shard", "keys", "counts").mapInArrow(build, "shard int, size long, bits binary").toLocalIterator()  # FILTER_MB in all
    return LogBloom(2, shard_bits, {r["shard"]: (r["size"], bytes(r["bits"])) for r in rows}), j == 0


def postings(docs: DataFrame, filter: LogBloom, whole: bool) -> DataFrame:
    """docs: (text).  (gram, key, n, pos) for each shingle of a prefix; without those that no other text holds, if the filter is whole."""
    shared = docs.sparkSession.sparkContext.broadcast(filter)  # FILTER_MB at most
    schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(0, batch.num_rows, 500):
                bodies = texts(batch.column(0).slice(k, 500))
                each = [shingles(t) for t in bodies]
                grams, sizes = np.concatenate(each), np.array([len(x) for x in each])
                owner, level = np.repeat(np.arange(len(each)), sizes), shared.value.level(grams.view(np.uint64) >> DROPPED << DROPPED)
                order = np.lexsort((level, owner))  # stable, so by hash among those of a level
                pos = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                take = pos < np.array([prefix(n) for n in sizes.tolist()])[owner]
                if whole:
                    take &= level[order] > 0
                at = owner[take]
                keys = np.array([key(t) if n else 0 for t, n in zip(bodies, np.bincount(at, minlength=len(each)).tolist())], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams[order][take]), pa.array(keys[at]), pa.array(sizes[at].astype(np.int32)), pa.array(pos[take].astype(np.int32))], schema=schema)

    return docs.select("text").mapInArrow(run, "gram long, key long, n int, pos int")


def possible(a: str, b: str) -> Column:
    """Whether two postings of a shingle may be the first shared one of linked sets."""
    return F.expr(f"9 * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= 4 * ({a}.n + {b}.n)")


def both(pairs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """The pairs (a, b) of keys with both keys' values: the first as xa and xb, the second as ya and yb."""
    for end in "ab":
        pairs = pairs.join(values.select(F.col("key").alias(end), *(F.col(name).alias(f"{x}{end}") for x, name in zip("xy", names))), end)
    return pairs


def links(docs: DataFrame, keyed: DataFrame, prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """(a, b), a < b: links of keys that give the components of all links; and the folder of the tables that they are read from.

    docs: (text); keyed: the same with key; prints: (key, fp), once each; linked: simhash.links.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "similar")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    near = stored(forest(linked(prints.select("fp").distinct())), "near")  # the links themselves grow with the square of a group
    least = prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    tips = [least.select(F.col("fp").alias(x), F.col("least").alias(f"k{x}")) for x in "ab"]
    pairs = prints.join(least, "fp").where("key != least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    pairs = pairs.union(near.join(tips[0], "a").join(tips[1], "b").select(F.least("ka", "kb"), F.greatest("ka", "kb")))
    some = least.where("n > 1").select("fp").union(near.select("a")).union(near.select("b")).distinct()
    members = stored(prints.join(some, "fp", "left_semi").select("key", "fp"), "members")

    found = stored(postings(docs, *frequent(docs)), "postings")
    several = found.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("gram")
    shared = stored(found.join(several, "gram", "left_semi").dropDuplicates(["gram", "key"]), "shared")
    asked = shared.select("key").union(members.select("key")).distinct()
    grams = stored(sets(docs, keyed, stored(asked, "asked")), "sets")  # a key comes once a task
    sketches = grams.select("key", "sketch").dropDuplicates(["key"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) of keys whose sets are linked."""
        size, least = (lambda x: F.aggregate(x, F.lit(0), lambda n, k: n + k)), F.zip_with("xa", "xb", lambda x, y: F.least(x, y))
        likely = both(stored(pairs, f"{name}-pairs"), sketches, "sketch").where(9 * size(least) >= 4 * (size("xa") + size("xb"))).select("a", "b")
        likely = stored(likely, f"{name}-likely")
        overlap = 9 * F.size(F.array_intersect("xa", "xb")) >= 4 * (F.size("xa") + F.size("xb"))
        return stored(both(likely, of(likely), "grams").where(overlap).select("a", "b"), name)

    def of(pairs: DataFrame) -> DataFrame:
        """The sets of the pairs' keys."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        return grams.join(needed, "key", "left_semi").dropDuplicates(["key"])

    def weighed(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) of keys of linked fingerprints that are linked by weight or as sets."""
        pairs = stored(pairs, f"{name}-pairs")
        overlap, sizes = F.size(F.array_intersect("xa", "xb")), F.size("xa") + F.size("xb")
        again, more = F.size(F.array_intersect("ya", "yb")), F.size("ya") + F.size("yb")
        alike = (9 * overlap >= 4 * sizes) | (9 * (overlap + again) >= 4 * (sizes + more))
        return stored(both(pairs, of(pairs), "grams", "again").where(alike).select("a", "b"), name)

    def ends(some: DataFrame, name: str) -> DataFrame:
        """The links of each text with the least and the greatest one of each of its shingles, if their components differ."""
        one = F.struct("key", "n", "pos", "root")
        least = some.groupBy("gram").agg(*(f(one).alias(x) for f, x in ((F.min, "low"), (F.max, "high"))))
        met = some.join(least, "gram").select(one.alias("x"), F.explode(F.array("low", "high")).alias("y"))
        return verified(pairs_of(met.where("x.root != y.root").where(possible("x", "y"))), name)

    def pairs_of(met: DataFrame) -> DataFrame:
        return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()

    def heaps(some: DataFrame, sizes: DataFrame, turn: int, name: str) -> DataFrame:
        """The links of texts of different components that meet in a heap of a shingle; sizes: (gram, n)."""
        number = F.pmod(F.xxhash64("gram", "key", F.lit(turn)), F.ceil(F.col("size") / HEAP))
        dealt = some.join(sizes.select("gram", F.col("n").alias("size")), "gram").withColumn("heap", number).drop("size")
        x, y = dealt.alias("x"), dealt.alias("y")
        return verified(pairs_of(x.join(y, F.expr("x.gram = y.gram and x.heap = y.heap and x.key < y.key and x.root != y.root") & possible("x", "y"))), name)

    def apart(some: DataFrame, pairs: DataFrame) -> DataFrame:
        """The postings of shingles that texts of different components hold, with their components."""
        roots = some.select("gram", "key", "n", "pos").join(components(pairs), F.col("key") == F.col("node"), "left").select("gram", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
        several = roots.groupBy("gram").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("gram")
        return roots.join(several, "gram", "left_semi")

    anchored = weighed(pairs, "anchored")
    so_far = anchored.union(ends(apart(shared, anchored), "first"))
    bound = shared.count()
    for turn in range(ROUNDS + 1):
        live = stored(apart(shared, so_far), f"live{turn}")
        held = live.groupBy("gram", "root").agg(F.count("*").alias("n")).groupBy("gram").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        held = stored(held, f"held{turn}")
        left = held.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0
        if turn == ROUNDS or left <= PAIRS * bound:
            break
        more = heaps(live, held, turn, f"turn{turn}")
        so_far = so_far.union(more)
        if more.isEmpty():
            break
    x, y = live.alias("x"), live.alias("y")
    rest = pairs_of(x.join(y, F.expr("x.gram = y.gram and x.key < y.key and x.root != y.root") & possible("x", "y")))
    as_sets = so_far.union(verified(rest, "rest"))
    rooted = members.join(components(as_sets), F.col("key") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "key").alias("root"))
    group = components(near).select(F.col("node").alias("fp"), F.col("root").alias("group"))
    rooted = stored(rooted.join(group, "fp", "left").withColumn("group", F.coalesce("group", "fp")), "rooted")
    mixed = rooted.groupBy("group").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("group")
    cells = stored(rooted.join(mixed, "group", "left_semi").select("fp", "root").distinct(), "cells")  # texts of one component aren't paired
    x, y = (cells.select(F.col("fp").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    last = x.join(y, F.expr("a = b and ra < rb")).select("a", "ra", "b", "rb").union(linked(cells))
    for x in "ab":
        last = last.join(rooted.select(F.col("fp").alias(x), F.col("root").alias(f"r{x}"), F.col("key").alias(f"k{x}")), [x, f"r{x}"])
    return as_sets.union(weighed(last.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct(), "last")), folder
